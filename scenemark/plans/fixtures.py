"""Inputs of the operators derived from the given tables.

Each derivation is one SELECT that both engines can run; ``Spark``/``Duck`` spell the
few expressions whose syntax differs.
"""

from __future__ import annotations

from scenemark import dims
from scenemark.plans.registry import Tables


class Spark:
    @staticmethod
    def h32(e: str) -> str:
        return f"cast(conv(substr(md5({e}),1,8),16,10) as bigint)"

    @staticmethod
    def arr(*xs: str) -> str:
        return f"array({', '.join(xs)})"

    @staticmethod
    def nth(arr: str, zero_based: str) -> str:
        return f"element_at({arr}, cast({zero_based} as int) + 1)"

    @staticmethod
    def split(s: str, sep: str) -> str:
        return f"split({s}, '{sep}')"

    @staticmethod
    def part(s: str, sep: str, n: int) -> str:
        return f"split_part({s}, '{sep}', {n})"

    nested = "struct"


class Duck(Spark):
    @staticmethod
    def h32(e: str) -> str:
        return f"('0x' || substr(md5({e}),1,8))::bigint"

    @staticmethod
    def arr(*xs: str) -> str:
        return f"[{', '.join(xs)}]"

    @staticmethod
    def nth(arr: str, zero_based: str) -> str:
        return f"({arr})[cast({zero_based} as int) + 1]"

    @staticmethod
    def split(s: str, sep: str) -> str:
        return f"string_split({s}, '{sep}')"


def _list(d, xs) -> str:
    return d.arr(*["'" + x.replace("'", "''") + "'" for x in xs])


# unique per line; keeps line order inside an order
SEQ = "(cast(l_linenumber as bigint) * 400000000000000000 + l_partkey * 10000000 + l_suppkey)"

#: image of a line item
IMAGE = f"concat(cast(l_orderkey as varchar(20)), '_', cast({SEQ} as varchar(20)))"


def shapes(d) -> str:
    """One shape per line item, one scene per order; coordinates are whole hundredths."""
    w = "(6 + 4 * cast(round(l_discount * 100) as int))"
    h = "(6 + 4 * cast(round(l_tax * 100) as int))"
    x = "(l_partkey % 97 + 1)"
    y = "((l_suppkey * 31 + l_linenumber * 17) % 89 + 5)"
    return f"""
    SELECT l_orderkey AS image_id, {SEQ} AS shape_idx, cast(l_linenumber as int) AS line_no,
           {d.nth(_list(d, dims.SHAPE_TYPES), 'l_partkey % 14')} AS type,
           {x} / 100.0 + 0.0 AS cx, {y} / 100.0 + 0.0 AS cy,
           ({x} - {w} / 2) / 100.0 + 0.0 AS min_x, ({y} + {h} / 2) / 100.0 + 0.0 AS max_y,
           ({x} + {w} / 2) / 100.0 + 0.0 AS max_x, ({y} - {h} / 2) / 100.0 + 0.0 AS min_y,
           {w} * {h} / 10000.0 + 0.0 AS area, greatest({w}, {h}) / 100.0 + 0.0 AS major_axis,
           0.0 AS rotation, cast(l_quantity as int) AS q
    FROM {{lineitem}}"""


RELATION_TEXTS = [
    "tangent line", "parallel", "perpendicular", "circumscribed circle", "inscribed circle", "shared edge", "diagonal",
    "major axis", "minor axis", "diameter", "concentric", "similar", "internal tangent circle", "symmetric",
]


def relations(d) -> str:
    """An edge from every shape to the first shape of the next line number in its scene."""
    rel = d.nth(_list(d, RELATION_TEXTS), "a.q % 14")
    return f"""
    SELECT a.image_id, a.shape_idx AS ord, a.shape_idx AS head, b.tail, {rel} AS relation
    FROM ({shapes(d)}) a
    JOIN (SELECT image_id, line_no, min(shape_idx) AS tail FROM ({shapes(d)}) s GROUP BY image_id, line_no) b
      ON a.image_id = b.image_id AND a.line_no + 1 = b.line_no"""


def replies(d) -> str:
    """Assistant turns as model replies to four-choice questions."""
    k = "concat_ws(':', cast(conv_id as varchar(20)), cast(turn as varchar(20))"
    choice = lambda i: f"substr(md5({k}, 'choice{i}')), 1, 2)"
    h = d.h32(f"{k}, 'truth')")
    g = d.h32(f"{k}, 'given')")
    return f"""
    SELECT concat('m', cast(conv_id % 4 as varchar(4))) AS model,
           {d.nth(_list(d, dims.PERSPECTIVES), 'turn % 6')} AS perspective,
           conv_id AS image_id, turn AS question_id, text,
           {d.arr(*[choice(i) for i in range(4)])} AS choices,
           {d.nth(d.arr(*[choice(i) for i in range(4)]), f'{h} % 4')} AS answer,
           cast({h} % 4 as bigint) AS truth_idx,
           CASE WHEN {g} % 3 = 0 THEN text
                ELSE concat(text, ' Answer: ', substr('ABCD', cast({g} % 7 % 4 as int) + 1, 1)) END AS response
    FROM {{conversations}} WHERE role = 'assistant'"""


def ratings(d) -> str:
    """Ratings per (image, feature) of line items."""
    return """
    SELECT concat(p_type, '_', p_brand, '_', cast(l_orderkey as varchar(20))) AS image, p_brand AS feature,
           CASE WHEN l_returnflag = 'R' THEN NULL ELSE floor(l_quantity / 5) + 0.0 END AS rating
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


def levels(d) -> str:
    return """
    SELECT p_type AS subject, cast(p_size % 5 + 1 as int) AS level, p_brand AS subfield,
           l_linestatus = 'F' AS correct, l_returnflag AS version,
           CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS judgement,
           cast(l_quantity as int) AS q
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


def reviews(d) -> str:
    return """
    SELECT o_orderkey AS question_id, o_orderpriority AS category,
           CASE WHEN o_custkey % 13 = 0 THEN 'no score'
                ELSE concat(cast(o_orderkey % 10 + 1 as varchar(4)),
                            CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE ',' END,
                            cast(o_custkey % 10 + 1 as varchar(4))) END AS review
    FROM {orders}"""


def pairs_text(d) -> str:
    """Whole text of a document against the document with the next id of the same parity class.

    The partner is found by key (doc_id - 1), not by a window over a source."""
    return """
    SELECT a.doc_id AS id, a.text AS prediction, b.text AS reference, a.source, a.lang
    FROM {documents} a JOIN {documents} b ON a.doc_id = b.doc_id + 1"""


def measure_text(d) -> str:
    q, q1 = "cast(cast(l_quantity as int) as varchar(8))", "cast(cast(l_quantity as int) + 1 as varchar(8))"
    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           {IMAGE} AS image,
           CASE l_linenumber % 6
             WHEN 0 THEN concat('near ', {q}, ' in the first, increasing to near ', {q1}, ' mm')
             WHEN 1 THEN concat('1:', {q}, '.5')
             WHEN 2 THEN concat({q}, '-', {q1}, ' microns')
             WHEN 3 THEN concat({q}, ' to ', {q1}, ' mm')
             WHEN 4 THEN concat({q}, ' or ', {q1}, ' mm')
             ELSE CASE WHEN l_linenumber > 6 THEN 'none given' ELSE concat('about ', {q}, '.25 mm') END END AS ref_text,
           CASE WHEN l_suppkey % 17 = 0 THEN 'unknown'
                WHEN l_linenumber % 6 = 2 THEN concat(cast(cast(l_quantity as int) + l_partkey % 5 as varchar(8)), ' microns')
                ELSE concat('about ', cast(cast(l_quantity as int) + l_partkey % 5 as varchar(8)), ' mm') END AS out_text
    FROM {{lineitem}}"""


def yes_no(d) -> str:
    return """
    SELECT d.doc_id AS question_id, lang AS category, text,
           CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS label
    FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""


_TABLES = {
    "shapes": ("lineitem",),
    "relations": ("lineitem",),
    "replies": ("conversations",),
    "ratings": ("lineitem", "part"),
    "levels": ("lineitem", "part"),
    "reviews": ("orders",),
    "pairs_text": ("documents",),
    "measure_text": ("lineitem",),
    "yes_no": ("documents", "labels"),
}


def spelled(text: str) -> str:
    """Texts as Spark names their type."""
    return text.replace("varchar(20)", "string").replace("varchar(8)", "string").replace("varchar(4)", "string")


def frame(t: Tables, name: str, heavy: bool = False):
    """The derived input as a Spark DataFrame."""
    return t.sql(spelled(globals()[name](Spark)), *_TABLES[name], heavy=heavy)


def sql(name: str) -> str:
    """The derived input as a DuckDB SELECT."""
    text = globals()[name](Duck)
    for tbl in _TABLES[name]:
        text = text.replace("{" + tbl + "}", tbl)
    return text


def ctes(*names: str, **extra: str) -> str:
    """``WITH a AS (…), b AS (…)`` of derived inputs and further SELECTs."""
    parts = [f"{n} AS ({sql(n)})" for n in names] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
