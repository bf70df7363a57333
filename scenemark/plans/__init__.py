"""Queries over the given tables, grouped by operator family."""


def load():
    """Import every plan module; returns (queries, oracle SQL)."""
    import importlib
    import pkgutil

    from scenemark.plans import registry

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.SQL
