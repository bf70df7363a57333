"""Wording of shape types, relations and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions.answers import let, literal_map
from scenemark.functions.rnd import _c


def _descriptions(parent: str, around: Column) -> Column:
    """Wordings of the children of ``parent`` that occur in ``around``, in declared order."""
    kids: dict[str, list[str]] = {}
    for child, desc in dims.TYPE_CHILDREN[parent]:
        kids.setdefault(desc, []).append(child)
    return F.filter(
        F.array(
            *[
                F.when(F.arrays_overlap(around, F.array(*[F.lit(c) for c in cs])), F.lit(d))
                for d, cs in kids.items()
            ]
        ),
        lambda d: d.isNotNull(),
    )


def parent_name(parent: str, present: Column, plural: bool = False) -> Column:
    """Wording of one type that can have children: 'ellipse (not circle)' or 'ellipses
    (excluding circles)' where a child occurs."""
    d = _descriptions(parent, present)
    if plural:
        named = F.concat(
            F.lit(f"{parent}s (excluding "), F.array_join(F.transform(d, lambda x: F.concat(x, F.lit("s"))), ", "), F.lit(")")
        )
    else:
        named = F.concat(F.lit(f"{parent} (not "), F.array_join(d, ", "), F.lit(")"))
    return F.when(F.size(d) > 0, named).otherwise(parent + "s" if plural else parent)


def clarify(kind: Column, present: Column, plural: bool = False) -> Column:
    """VQA-10: the wording of any type; types without children keep their name."""
    out = None
    for parent in dims.TYPE_CHILDREN:
        val = parent_name(parent, present, plural)
        out = F.when(kind == parent, val) if out is None else out.when(kind == parent, val)
    return out.otherwise(F.concat(kind, F.lit("s")) if plural else kind)


def clarify_choices(choices: Column, answer: Column, image_types: Column) -> Column:
    """VQA-11: struct(choices, answer) with parents marked where a child is around.

    Parents are handled in declared order, each seeing the choices already rewritten."""
    state = F.struct(choices.alias("choices"), answer.alias("answer"))
    for parent in dims.TYPE_CHILDREN:
        state = let(state, _choice_step(parent, image_types))
    return state


def _choice_step(parent: str, image_types: Column):
    def step(s):
        d = _descriptions(parent, F.concat(s["choices"], image_types))
        text = F.concat(
            F.lit(f"{parent} ("), F.array_join(F.transform(d, lambda x: F.concat(x, F.lit("s"))), ", "), F.lit(" excluded)")
        )
        hit = F.array_contains(s["choices"], parent) & (F.size(d) > 0)
        swap = lambda c: F.when(c == parent, text).otherwise(c)
        return F.struct(
            F.when(hit, F.transform(s["choices"], swap)).otherwise(s["choices"]).alias("choices"),
            F.when(hit, swap(s["answer"])).otherwise(s["answer"]).alias("answer"),
        )

    return step


def canonical_relation(col) -> Column:
    """VQA-9: canonical relation; NULL for relations that need more than two shapes."""
    r = _c(col)
    return (
        F.when(r.contains("tangent"), "tangent")
        .when(r.contains("circumscribed"), "circumscribed")
        .when(r.contains("inscribed"), "inscribed")
        .when(r.isin(*dims.AMBIGUOUS_RELATIONS), F.lit(None).cast("string"))
        .otherwise(r)
    )


def inverse_relation(rel: Column) -> Column:
    return F.try_element_at(literal_map(dims.RELATION_INVERSE), rel)


def quadrant(x: Column, y: Column, rx, ry) -> Column:
    """Position against a reference point; NULL within the margin on either axis."""
    near = F.least(F.abs(x - rx), F.abs(y - ry)) < dims.LOCATION_MARGIN
    return F.when(
        ~near,
        F.concat(F.when(y > ry, "upper ").otherwise("lower "), F.when(x < rx, "left").otherwise("right")),
    )


def plural_mark(text: Column, mark: str) -> Column:
    """Append ``mark`` to the noun, before any bracket."""
    return F.when(text.contains(" ("), F.replace(text, F.lit(" ("), F.lit(mark + " ("))).otherwise(
        F.concat(text, F.lit(mark))
    )
