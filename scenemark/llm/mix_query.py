"""The production mix over documents and the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levels() -> dict[str, Column]:
    """Domain / language / source; domains stand behind the last digit of the sources' names."""
    number = F.regexp_extract("source", "([0-9])$", 1).cast("int")
    domain = F.element_at(F.array(*map(F.lit, ("web", "books", "code"))), (number % 3 + 1).cast("int"))
    return {"domain": F.when(F.col("source").rlike("[0-9]$"), domain).otherwise("other"), "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {"web": 5, "books": 3, "code": 2, "other": 1, "web/en": 3, "web/de": 2, "books/es": 4, "code/fr": 0.5, "web/en/src0": 6}
SHARE = 0.6
EPOCHS = 2
SEED = "mix"

_LEVELS = ["domain", "lang", "source"]
_CASE = "CASE {path} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"


def _sql() -> str:
    path = lambda n: " || '/' || ".join(_LEVELS[:n])
    parts = [
        """d AS (SELECT doc_id, CASE WHEN regexp_matches(source, '[0-9]$') THEN ['web', 'books', 'code'][regexp_extract(source, '([0-9])$', 1)::INT % 3 + 1] ELSE 'other' END AS domain,
        coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents)""",
        f"l0 AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS t, count(*) AS n, sum(tokens)::DOUBLE * {EPOCHS} AS cap FROM d GROUP BY ALL)",
        f"b0 AS (SELECT *, least(floor(sum(t) OVER () * {SHARE}::DOUBLE), sum(cap) OVER ()) AS b FROM l0)",
    ]
    for n in (1, 2, 3):
        keys, above = ", ".join(_LEVELS[:n]), ", ".join(_LEVELS[: n - 1])
        by = f"PARTITION BY {above}" if above else ""
        parts += [
            f"n{n} AS (SELECT {keys}, sum(cap) AS cap, max(b) AS b, {_CASE.format(path=path(n))} AS w FROM b{n - 1} GROUP BY {keys})",
            f"""p{n} AS (SELECT *, b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS has, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM n{n} WINDOW o AS ({by} ORDER BY cap / w, {keys}))""",
            f"q{n} AS (SELECT *, cap * rest <= w * has AS isfull FROM p{n})",
            f"""g{n} AS (SELECT {keys}, CASE WHEN isfull THEN cap ELSE least(cap, w * max(CASE WHEN NOT isfull AND pos = 1 THEN has / rest END) OVER ({by})) END AS b
            FROM (SELECT *, row_number() OVER (PARTITION BY isfull{', ' + above if above else ''} ORDER BY cap / w, {keys}) AS pos FROM q{n}))""",
            f"b{n} AS (SELECT b{n - 1}.* EXCLUDE (b), g{n}.b FROM b{n - 1} JOIN g{n} USING ({keys}))",
        ]
    parts += [
        "f AS (SELECT domain, lang, source, CASE WHEN t > 0 THEN floor(b + 1e-6)::BIGINT // t::BIGINT ELSE 0 END AS whole, CASE WHEN t > 0 THEN floor(b + 1e-6)::BIGINT % t::BIGINT ELSE 0 END AS part FROM b3)",
        f"""r AS (SELECT d.*, whole, part, coalesce(sum(tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{SEED}:' || whole || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM d JOIN f USING (domain, lang, source))""",
    ]
    return f"""WITH {', '.join(parts)}
    SELECT doc_id, domain, lang, source, tokens, e::INT AS epoch, tokens AS used FROM (SELECT *, unnest(range(0, whole)) AS e FROM r)
    UNION ALL SELECT doc_id, domain, lang, source, tokens, whole::INT, greatest(0, least(tokens, part - start))::BIGINT FROM r WHERE start < part"""


SQL = _sql()
