"""CAP: rule-based caption features."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions import classes as K
from scenemark.functions import geometry as G
from scenemark.functions.numeric import rnd
from scenemark.operators import captions as C
from scenemark.plans.fixtures import ctes, frame
from scenemark.plans.geo import R
from scenemark.plans.registry import query
from scenemark.plans.vqa import H, U
from scenemark.plans.vqa import shapes as scene_shapes

_LO, _HI = (1 - 1 / 3) / 2, 1 - (1 - 1 / 3) / 2


def case_in(x: str, table: dict) -> str:
    return "(CASE " + " ".join(f"WHEN {x} >= {float(lo)!r}::DOUBLE AND {x} <= {float(hi)!r}::DOUBLE THEN '{k}'" for k, (lo, hi) in table.items()) + " ELSE '' END)"


def cell_sql(x, y, x1, x2, y1, y2) -> str:
    cols = {"left": f"{x} < {x1}", "": f"{x} <= {x2}", "right": "true"}
    rows = {"bottom": f"{y} < {y1}", "": f"{y} <= {y2}", "top": "true"}
    out = "CASE"
    for r, rc in rows.items():
        out += f" WHEN {rc} THEN CASE " + " ".join(f"WHEN {cc} THEN '{'-'.join(v for v in (r, c) if v) or 'center'}'" for c, cc in cols.items()) + " END"
    return f"({out} END)"


_S = dict(s="SELECT image_id, shape_idx, type, cx::DOUBLE AS cx, cy::DOUBLE AS cy, major_axis::DOUBLE AS weight, q FROM shapes")
KEY = ["image_id", "shape_idx"]


def placed(t):
    """Scene shapes with a name and a weight; centres snapped so that some are shared."""
    s = scene_shapes(t)
    return s.select(*KEY, F.col("type").alias("name"), F.bround(F.floor(F.col("cx") * 5) / 5.0 + 0.1, 4).alias("cx"), F.bround(F.floor(F.col("cy") * 5) / 5.0 + 0.1, 4).alias("cy"), F.col("major_axis").alias("weight"))


_P = dict(**_S, p="SELECT image_id, shape_idx, type AS name, round_even(floor(cx * 5) / 5.0::DOUBLE + 0.1::DOUBLE, 4) AS cx, round_even(floor(cy * 5) / 5.0::DOUBLE + 0.1::DOUBLE, 4) AS cy, weight FROM s")


@query(
    "cap_01_grid_label",
    ctes("shapes", **_S) + f"SELECT image_id, shape_idx, {cell_sql('cx', 'cy', f'{_LO!r}::DOUBLE', f'{_HI!r}::DOUBLE', f'{_LO!r}::DOUBLE', f'{_HI!r}::DOUBLE')} AS cell FROM s",
)
def _(t):
    return scene_shapes(t).select(*KEY, C.grid_label("cx", "cy", _LO, _HI, _LO, _HI).alias("cell"))


_CUT = "({lo} + ({hi} - {lo} - ({hi} - {lo}) * {t!r}::DOUBLE) / 2.0::DOUBLE)"
_CUH = "({hi} - ({hi} - {lo} - ({hi} - {lo}) * {t!r}::DOUBLE) / 2.0::DOUBLE)"


def cuts(lo, hi):
    return _CUT.format(lo=lo, hi=hi, t=1 / 3), _CUH.format(lo=lo, hi=hi, t=1 / 3)


_X, _Y = cuts("l", "r"), cuts("b", "t")


@query(
    "cap_02_grid_label_rel",
    ctes("shapes", **_S, e="SELECT image_id, min(cx) AS l, max(cx) AS r, min(cy) AS b, max(cy) AS t FROM s GROUP BY 1")
    + f"SELECT image_id, shape_idx, {cell_sql('cx', 'cy', _X[0], _X[1], _Y[0], _Y[1])} AS cell FROM s JOIN e USING (image_id)",
)
def _(t):
    return C.grid_label_rel(scene_shapes(t)).select(*KEY, "cell")


def _sub_sql(cell: str) -> dict[str, str]:
    """Ends of the cell along both axes, from cuts x1, x2, y1, y2 and origin xb, yb."""
    has = lambda w: f"contains({cell}, '{w}')"
    return dict(
        x0=f"CASE WHEN {has('left')} THEN xb WHEN {has('right')} THEN x2 ELSE x1 END",
        x9=f"CASE WHEN {has('left')} THEN x1 WHEN {has('right')} THEN x2 + x1 - xb ELSE x2 END",
        y0=f"CASE WHEN {has('bottom')} THEN yb WHEN {has('top')} THEN y2 ELSE y1 END",
        y9=f"CASE WHEN {has('bottom')} THEN y1 WHEN {has('top')} THEN y2 + y1 - yb ELSE y2 END",
    )


def _levels(depth: int) -> dict[str, str]:
    out = dict(
        d0=f"SELECT image_id, cx, cy, list(DISTINCT name) AS names, {_LO!r}::DOUBLE AS x1, {_HI!r}::DOUBLE AS x2, {_LO!r}::DOUBLE AS y1, {_HI!r}::DOUBLE AS y2, 0.0::DOUBLE AS xb, 0.0::DOUBLE AS yb, 'canvas' AS path, true AS split FROM p GROUP BY 1, 2, 3"
    )
    x, y = cuts("x0", "x9"), cuts("y0", "y9")
    for k in range(depth):
        sub = ", ".join(f"{e} AS {n}" for n, e in _sub_sql("cell").items())
        out[f"c{k}"] = f"SELECT *, {cell_sql('cx', 'cy', 'x1', 'x2', 'y1', 'y2')} AS cell FROM d{k}"
        out[f"g{k}"] = f"SELECT *, {sub} FROM c{k}"
        out[f"h{k}"] = (
            f"SELECT image_id, cx, cy, names, CASE WHEN split THEN {x[0]} ELSE x1 END AS x1, CASE WHEN split THEN {x[1]} ELSE x2 END AS x2, CASE WHEN split THEN {y[0]} ELSE y1 END AS y1, "
            f"CASE WHEN split THEN {y[1]} ELSE y2 END AS y2, CASE WHEN split THEN x0 ELSE xb END AS xb, CASE WHEN split THEN y0 ELSE yb END AS yb, CASE WHEN split THEN path || '::' || cell ELSE path END AS path FROM g{k}"
        )
        out[f"n{k}"] = f"SELECT DISTINCT image_id, path FROM (SELECT image_id, path, unnest(names) AS name FROM h{k}) GROUP BY image_id, path, name HAVING count(*) > 1"
        out[f"d{k + 1}"] = f"SELECT h.*, n.path IS NOT NULL AS split FROM h{k} h LEFT JOIN n{k} n ON h.image_id = n.image_id AND h.path = n.path"
    return out


_LV = _levels(8)
_RING = "SELECT image_id, shape_idx, row_number() OVER (PARTITION BY image_id, cx, cy ORDER BY weight, shape_idx) - 1 AS ring, count(*) OVER (PARTITION BY image_id, cx, cy) AS m FROM p"


@query(
    "cap_03_05_disambiguate",
    ctes("shapes", **_P, **_LV) + "SELECT image_id, cx, cy, path FROM d4",
)
def _(t):
    return C.disambiguate(placed(t))


@query("cap_04_concentric_groups", ctes("shapes", **_P, r=_RING) + "SELECT image_id, shape_idx, ring::INT AS ring FROM r WHERE m > 1")
def _(t):
    return C.concentric_groups(placed(t)).select(*KEY, "ring")


_ORD = "[" + ", ".join(f"'{w}'" for w in dims.ORDINALS) + "]"


@query(
    "cap_05_shape_paths",
    ctes("shapes", **_P, **_LV, r=_RING)
    + f"SELECT p.image_id, p.shape_idx, d4.path || CASE WHEN m > 1 THEN '::concentric::the ' || ({_ORD})[ring + 1] || ' shape from the inside, counting outward' ELSE '' END || '::' || name AS selector FROM p JOIN r USING (image_id, shape_idx) JOIN d4 ON p.image_id = d4.image_id AND p.cx = d4.cx AND p.cy = d4.cy",
)
def _(t):
    return C.shape_paths(placed(t)).select(*KEY, "selector")


@query(
    "cap_06_mass_center",
    ctes("shapes", **_S) + f"SELECT image_id, {R('sum(cx * weight) / sum(weight)', 6)} AS x, {R('sum(cy * weight) / sum(weight)', 6)} AS y FROM s GROUP BY 1",
)
def _(t):
    s = scene_shapes(t).withColumn("weight", F.col("major_axis"))
    return C.mass_center(s).select("image_id", rnd("x", 6).alias("x"), rnd("y", 6).alias("y"))


_PH = "CASE " + " ".join(f"WHEN contains(relation, '{k}') THEN '{v}'" for k, v in reversed(dims.RELATION_PHRASES.items())) + " ELSE '' END"


@query(
    "cap_07_relation_phrase",
    ctes("shapes", "relations", **_S)
    + f""", j AS (SELECT r.*, s.type AS name FROM relations r JOIN s ON r.image_id = s.image_id AND r.head = s.shape_idx WHERE NOT contains(relation, 'concentric')),
    k AS (SELECT *, CASE WHEN contains(relation, 'inscribed circle') OR contains(relation, 'circumscribed circle') OR contains(relation, 'tangent circle') THEN NOT contains(name, 'circle')
      WHEN contains(relation, 'tangent line') THEN NOT (contains(name, 'line') OR contains(name, 'ray') OR contains(name, 'segment'))
      WHEN relation IN ('major axis', 'minor axis', 'diameter') THEN NOT contains(name, 'segment') ELSE false END AS sw FROM j)
    SELECT image_id, ord, CASE WHEN sw THEN tail ELSE head END AS src, {_PH} AS phrase, CASE WHEN sw THEN head ELSE tail END AS dst FROM k""",
)
def _(t):
    s = scene_shapes(t).select(*KEY, F.col("type").alias("name"))
    return C.relation_phrase(frame(t, "relations"), s)


_NM = ["rectangle", "square", "equilateral triangle", "circle", "polygon", "ellipse", "segment", "star"]


def numbered(t):
    s = scene_shapes(t)
    b, k = F.col("box"), (F.col("shape_idx") % 8).cast("int")
    w, h = b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]
    corner = F.array(G.pt(b["min_x"], b["min_y"]), G.pt(b["max_x"], b["min_y"]), G.pt(b["max_x"], b["max_y"]), G.pt(b["min_x"], b["max_y"]))
    s = s.withColumn("name", F.get(F.array(*[F.lit(x) for x in _NM]), k))
    info = C.numeric_info("name", corner, w, h)
    return s.select(*KEY, F.col("name").alias("selector"), C.kept_numeric_info(info, 0.6, "num", "image_id", "shape_idx").alias("info"))


_NUM = dict(
    s="SELECT image_id, shape_idx, (shape_idx % 8)::INT AS k, max_x::DOUBLE - min_x::DOUBLE AS w, max_y::DOUBLE - min_y::DOUBLE AS h FROM shapes",
    i=f"""SELECT *, (['{"','".join(_NM)}'])[k + 1] AS name, CASE WHEN {U('num', 'image_id', 'shape_idx')} < 0.6 THEN
       (CASE k WHEN 0 THEN [greatest(w, h), least(w, h)] WHEN 1 THEN [greatest(w, h)] WHEN 2 THEN [w] WHEN 3 THEN [w] WHEN 4 THEN [4.0] WHEN 5 THEN [w, h] WHEN 6 THEN [w] ELSE [] END) ELSE [] END AS v FROM s""",
    j="SELECT *, (CASE k WHEN 0 THEN ['width','height'] WHEN 1 THEN ['side length'] WHEN 2 THEN ['side length'] WHEN 3 THEN ['diameter'] WHEN 4 THEN ['number of sides'] WHEN 5 THEN ['major axis','minor axis'] WHEN 6 THEN ['length'] ELSE [] END) AS a FROM i",
)


@query(
    "cap_08_numeric_info",
    ctes("shapes", **_NUM) + "SELECT image_id, shape_idx, coalesce(a[1], '') AS attr, round_even(v[1], 2) AS value, len(v) AS n FROM j WHERE len(v) > 0",
)
def _(t):
    i = F.get("info", 0)
    return numbered(t).filter(F.size("info") > 0).select(*KEY, i["attr"].alias("attr"), i["value"].alias("value"), F.size("info").cast("bigint").alias("n"))


HEADS = {
    "start": ["Describe the figure. ", "Give an account of the figure. "],
    "start1": ["Explain the figure, ", "Depict the figure, "],
    "start2": ["using the numbers. ", "with its numbers. ", "numbers included. "],
    "numbers": ["Here are numbers. ", "Numbers follow. "],
    "end": ["Mind the positions.", "State positions. "],
}


def _pool(name):
    xs = HEADS[name]
    return "([" + ", ".join(f"'{x}'" for x in xs) + f"])[('0x' || substr({H(f'cap:{name}', 'image_id')}, 1, 8))::BIGINT % {len(xs)} + 1]"


@query(
    "cap_09_caption_input",
    ctes("shapes", **_NUM)
    + f""", k2 AS (SELECT image_id, shape_idx, CASE len(v) WHEN 1 THEN 'The ' || a[1] || ' of "' || name || '" is ' || round_even(v[1], 2)::VARCHAR || '. '
       WHEN 2 THEN 'The ' || a[1] || ' and ' || a[2] || ' of "' || name || '" are ' || round_even(v[1], 2)::VARCHAR || ' and ' || round_even(v[2], 2)::VARCHAR || ', respectively. ' END AS s FROM j),
    l AS (SELECT image_id, coalesce(string_agg(s, '' ORDER BY shape_idx), '') AS b, count(s) AS n FROM k2 GROUP BY 1)
    SELECT image_id, trim((CASE WHEN n = 0 THEN {_pool('start')} || {_pool('end')} WHEN {U('cap:head', 'image_id')} > 0.5 THEN {_pool('start')} || {_pool('numbers')} || {_pool('end')}
      ELSE {_pool('start1')} || {_pool('start2')} || {_pool('end')} END) || b) AS input FROM l""",
)
def _(t):
    return C.caption_input(numbered(t), HEADS, "cap")


@query(
    "cap_09_caption_selectors",
    ctes(
        "shapes", **_P, **_LV, r=_RING,
        sel=f"SELECT p.image_id, p.shape_idx, d4.path || CASE WHEN m > 1 THEN '::concentric::the ' || ({_ORD})[ring + 1] || ' shape from the inside, counting outward' ELSE '' END || '::' || p.name AS name FROM p JOIN r USING (image_id, shape_idx) JOIN d4 ON p.image_id = d4.image_id AND p.cx = d4.cx AND p.cy = d4.cy",
        **{f"n_{k}": re.sub(r" FROM (s|i)\b", r" FROM n_\1", v) for k, v in _NUM.items()},
        k2="""SELECT image_id, shape_idx, CASE len(v) WHEN 1 THEN 'The ' || a[1] || ' of "' || sel.name || '" is ' || round_even(v[1], 2)::VARCHAR || '. '
       WHEN 2 THEN 'The ' || a[1] || ' and ' || a[2] || ' of "' || sel.name || '" are ' || round_even(v[1], 2)::VARCHAR || ' and ' || round_even(v[2], 2)::VARCHAR || ', respectively. ' END AS s FROM n_j JOIN sel USING (image_id, shape_idx)""",
        l="SELECT image_id, coalesce(string_agg(s, '' ORDER BY shape_idx), '') AS b, count(s) AS n FROM k2 GROUP BY 1",
    )
    + f"""SELECT image_id, trim((CASE WHEN n = 0 THEN {_pool('start')} || {_pool('end')} WHEN {U('cap:head', 'image_id')} > 0.5 THEN {_pool('start')} || {_pool('numbers')} || {_pool('end')}
      ELSE {_pool('start1')} || {_pool('start2')} || {_pool('end')} END) || b) AS input FROM l""",
)
def _(t):
    """Captions whose paths are those of the cells and rings."""
    info = numbered(t).select(*KEY, "info")
    return C.caption_input(C.shape_paths(placed(t)).select(*KEY, "selector").join(info, KEY), HEADS, "cap")


@query(
    "cap_10_range_class",
    "SELECT event_id, " + case_in("(value / 10)", dims.RANGES["ellipse"]) + " AS one, " + case_in("value", dims.RANGES["shell_pole"]) + " AS joined FROM events",
)
def _(t):
    table = t.spark.createDataFrame([(k, float(a), float(b), i) for i, (k, (a, b)) in enumerate(dims.RANGES["shell_pole"].items())], "label string, lo double, hi double, ord int")
    e = t.events.select("event_id", "value", K.range_class(F.col("value") / 10, dims.RANGES["ellipse"]).alias("one"))
    return K.range_class_join(e, "value", table, "joined").drop("value")


_PRI = ["straight", "slightly fluted", "fluted", "strongly fluted"]


@query(
    "cap_11_by_priority",
    "WITH x AS (SELECT event_id, event_id % 4 AS a, user_id % 4 AS b FROM events) SELECT event_id, (['" + "','".join(_PRI) + "'])[greatest(a, b) + 1] AS top, CASE WHEN b > 2 THEN 'high' WHEN a > 0 THEN 'some' ELSE '' END AS last, concat_ws(', ', CASE WHEN a > 1 THEN 'a' END, CASE WHEN b > 1 THEN 'b' END) AS parts FROM x",
)
def _(t):
    a, b = (F.col("event_id") % 4).cast("int"), (F.col("user_id") % 4).cast("int")
    arr = F.array(*[F.lit(x) for x in _PRI])
    return t.events.select(
        "event_id", K.by_priority(F.array(F.get(arr, a), F.get(arr, b)), _PRI).alias("top"), K.last_true([(a > 0, "some"), (b > 2, "high")]).alias("last"),
        K.comma_join(F.when(a > 1, "a").otherwise(""), F.when(b > 1, "b").otherwise("")).alias("parts"),
    )


@query("cap_21_ordinal", f"SELECT event_id, ({_ORD})[event_id % 105 + 1] AS word FROM events")
def _(t):
    return t.events.select("event_id", K.ordinal(F.col("event_id") % 105).alias("word"))


# --- shells: one scene per order, whorls are its lines ----------------------------------------


def shell_shapes(t):
    l = t.lineitem
    k, q = F.col("l_orderkey") % 3, F.col("l_quantity")
    kind = F.when(k == 0, "ellipse").when(k == 1, "curves").otherwise("fusiform_1")
    n = (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).cast("string")
    return l.select(
        F.col("l_orderkey").alias("image_id"), kind.alias("type"), F.when(F.col("l_partkey") % 11 == 0, "initial chamber").otherwise(F.concat(F.lit("volution "), n)).alias("special_info"),
        (q / 64).alias("major_axis"), (F.col("l_linenumber") / 32).alias("minor_axis"), (q / 128).alias("x_start"), (q / 32 + 1).alias("x_end"), (F.col("l_linenumber") / 4 + 1).alias("ratio"),
        F.array(G.pt(q / 16, 0), G.pt(0, 0.75), G.pt(0.25, 0), G.pt(0, F.col("l_linenumber") / 16)).alias("vertices"),
    ).groupBy("image_id", "special_info").agg(F.max_by(F.struct("type", "major_axis", "minor_axis", "x_start", "x_end", "ratio", "vertices"), "major_axis").alias("s")).select("image_id", "special_info", "s.*")


_OUT = """WITH l AS (SELECT l_orderkey AS image_id, l_linenumber * 1000 + l_partkey % 1000 AS vi, l_quantity AS q, l_linenumber AS ln FROM lineitem WHERE l_partkey % 11 <> 0),
 u AS (SELECT image_id, vi, ln, max(q) AS q FROM l GROUP BY 1, 2, 3), o AS (SELECT image_id, arg_max(q, vi) AS q, arg_max(ln, vi) AS ln FROM u GROUP BY 1),
 w AS (SELECT image_id, image_id % 3 AS k, q, ln, CASE image_id % 3 WHEN 0 THEN q / 64 WHEN 1 THEN abs(0.25 - q / 16) ELSE q / 32 + 1 - q / 128 END AS width,
   CASE image_id % 3 WHEN 0 THEN ln / 32 WHEN 1 THEN abs(0.75 - ln / 16) ELSE (q / 32 + 1 - q / 128) / (ln / 4 + 1) END AS height FROM o),
 f AS (SELECT *, CASE WHEN k = 2 THEN ln / 4 + 1 ELSE width / nullif(height, 0) END AS ratio, CASE image_id % 3 WHEN 0 THEN 'ellipse' WHEN 1 THEN 'curves' ELSE 'fusiform_1' END AS type FROM w)"""


@query("cap_12_outer_whorl", _OUT + f"SELECT image_id, type, {R('width', 6)} AS width, {R('height', 6)} AS height, {R('ratio', 6)} AS ratio FROM f")
def _(t):
    o = C.outer_whorl(shell_shapes(t))
    return o.select("image_id", "type", *[rnd(c, 6).alias(c) for c in ("width", "height", "ratio")])


_MM = lambda v: f"({v} * 1280.0::DOUBLE / (136.0::DOUBLE + (image_id % 50)))"
_RT = dims.RANGES


@query(
    "cap_13_shell_features",
    _OUT
    + f""", g AS (SELECT *, round_even(ratio, 1) AS r1, (image_id % 180)::DOUBLE AS ta, (image_id % 100)::DOUBLE AS ba, (image_id % 150)::DOUBLE AS la, (image_id % 140)::DOUBLE AS ra FROM f),
    c AS (SELECT *, {case_in('ta', _RT['shell_equator'])} AS e1, {case_in('ba', _RT['shell_equator'])} AS e2, {case_in('la', _RT['shell_pole'])} AS pl, {case_in('ra', _RT['shell_pole'])} AS pr FROM g)
    SELECT image_id, {case_in(_MM('width') + ' * ' + _MM('height'), _RT['shell_size'])} AS size, CASE WHEN k = 2 THEN {case_in('r1', _RT['fusiform'])} ELSE {case_in('r1', _RT['ellipse'])} END AS shape,
     CASE WHEN k = 1 THEN CASE WHEN e1 = e2 THEN e1 WHEN e1 = 'inflated' THEN 'top inflated' WHEN e2 = 'inflated' THEN 'bottom inflated' END ELSE {case_in('(r1 * 20)', _RT['shell_equator'])} END AS equator,
     CASE WHEN k = 2 THEN 'concave' ELSE 'convex' END AS slope,
     CASE WHEN k = 1 THEN CASE WHEN pl = pr THEN pr || ' ends' ELSE pr || ' right pole and ' || pl || ' left pole' END WHEN k = 2 THEN 'sharply pointed ends' ELSE {case_in('r1', _RT['shell_ellipse_pole'])} || ' ends' END AS pole,
     {R(_MM('width'), 1)} AS length_mm FROM c WHERE height > 0""",
)
def _(t):
    i = F.col("image_id")
    o = C.outer_whorl(shell_shapes(t)).filter("height > 0").select(
        "*", (i % 50).alias("offset"), (i % 180).cast("double").alias("top_angle"), (i % 100).cast("double").alias("bottom_angle"),
        (i % 150).cast("double").alias("left_angle"), (i % 140).cast("double").alias("right_angle"),
    )
    f = C.shell_features(o).join(o.select("image_id", rnd(C.mm("width", "offset"), 1).alias("mm1")), "image_id")
    return f.select("image_id", "size", "shape", "equator", "slope", "pole", F.col("mm1").alias("length_mm"))


def whorls(t):
    """Eight whorls per user with growing heights."""
    e = t.events.groupBy("user_id", (F.col("event_id") % 8).cast("int").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(
        F.col("user_id").alias("image_id"), F.col("w").alias("whorl"), (F.col("w") * 0.125 + F.col("w") * F.col("w") * ((F.col("user_id") % 5) / 64.0)).alias("height"),
        (F.col("w") * 0.5 + 1.0).alias("width"),
    )


_WH = """WITH w AS (SELECT DISTINCT user_id AS image_id, (event_id % 8)::INT AS whorl FROM events), h AS (SELECT image_id, whorl, whorl * 0.125::DOUBLE + whorl * whorl * ((image_id % 5) / 64.0::DOUBLE) AS height, whorl * 0.5::DOUBLE + 1.0 AS width FROM w)"""


@query(
    "cap_14_whorl_features",
    _WH
    + f""", r AS (SELECT image_id, whorl, greatest(round_even(height, 3), 0.001::DOUBLE) AS h FROM h), g AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY whorl) - 1 AS i, lead(h) OVER (PARTITION BY image_id ORDER BY whorl) - h AS d FROM r),
    c AS (SELECT image_id, i, {case_in('d', _RT['coiling'])} AS w FROM g WHERE d IS NOT NULL),
    f AS (SELECT image_id, list(w ORDER BY i) AS l FROM c GROUP BY 1),
    k AS (SELECT image_id, l, l[1] AS a, l[len(l)] AS b, coalesce(list_min([i for i in range(1, len(l) + 1) if l[i] <> l[1]]), len(l) + 1) - 2 AS pos1, len([x for x in l if x <> l[1]]) > 0 AS two FROM f)
    SELECT image_id, array_to_string(l, '|') AS labels, CASE WHEN NOT two OR a = b THEN a WHEN contains(a, 'moderate') THEN b || ' in outer volutions' WHEN contains(b, 'moderate') THEN a || ' in first ' || (pos1 + 2) || ' volutions'
     ELSE a || ' in first ' || (pos1 + 2) || ' volutions while ' || b || ' in outer volutions' END AS coiling FROM k""",
)
def _(t):
    return C.whorl_features(whorls(t)).select("image_id", F.array_join("labels", "|").alias("labels"), "coiling")


def chomata(t):
    v = F.col("value")
    return t.events.filter("event_id % 3 > 0 OR user_id % 4 > 0").select(
        F.col("user_id").alias("image_id"), (F.col("event_id") % 8).cast("int").alias("whorl"), (v / 2000.0).alias("size"), (v / 800.0).alias("width"), (v / 400.0).alias("height"),
        F.when(F.col("event_id") % 7 == 0, -1.0).otherwise((F.col("event_id") % 5).cast("double") + 0.5).alias("x"), F.when(F.col("event_id") % 7 == 0, -1.0).otherwise((F.col("event_id") % 9 - 4).cast("double") + 0.25).alias("y"),
    )


_CHO = _WH + """, c AS (SELECT user_id AS image_id, (event_id % 8)::INT AS whorl, value / 2000 AS size, value / 800 AS width, value / 400 AS height,
  CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE (event_id % 5) + 0.5 END AS x, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE (event_id % 9 - 4) + 0.25 END AS y FROM events WHERE event_id % 3 > 0 OR user_id % 4 > 0)"""


def _two_sql(i, o, joiner, absent):
    base = f"CASE WHEN {i} = {o} THEN {i} ELSE {i} || ' in inner volutions{joiner}' || {o} || ' in outer volutions' END"
    if not absent:
        return base
    return f"CASE WHEN {i} = 'absent' AND {o} = 'absent' THEN '' WHEN {i} = 'absent' THEN {o} || ' in outer volutions' WHEN {o} = 'absent' THEN {i} || ' in inner volutions' ELSE {base} END"


@query(
    "cap_15_chomata_features",
    _CHO
    + f""", m AS (SELECT image_id, whorl, avg(size) AS s, avg(width) AS w, avg(height) AS h, count(*) AS k FROM c GROUP BY 1, 2), n AS (SELECT image_id, count(*) AS n FROM h GROUP BY 1),
    g AS (SELECT a.image_id, a.whorl, b.width - a.width AS gw, b.height - a.height AS gh FROM h a JOIN h b ON a.image_id = b.image_id AND b.whorl = a.whorl + 1),
    r AS (SELECT m.image_id, n, k, m.whorl < n / 2 AS inn, s / nullif(gw * gh, 0) AS s, w / nullif(gw, 0) AS w, h / nullif(gh, 0) AS h FROM m JOIN g USING (image_id, whorl) JOIN n USING (image_id)),
    a AS (SELECT image_id, {', '.join(f"{case_in(f'coalesce(avg({c}) FILTER ({cond}), 0)', _RT['chomata_' + nm])} AS {c}{sfx}" for c, nm in (('s', 'size'), ('w', 'width'), ('h', 'height')) for cond, sfx in (('inn', 'i'), ('NOT inn', 'o')))},
      {case_in('(sum(k) / max(n))', _RT['chomata_development'])} AS dev FROM r GROUP BY 1),
    z AS (SELECT image_id, {_two_sql('si', 'so', ' while ', False)} AS size, {_two_sql('hi', 'ho', ' and ', True)} AS height, {_two_sql('wi', 'wo', ' and ', True)} AS width, dev AS development FROM a)
    SELECT *, 'Chomata ' || concat_ws(', ', nullif(size, ''), nullif(height, ''), nullif(width, ''), nullif(development, '')) || '. ' AS text FROM z""",
)
def _(t):
    return C.chomata_features(chomata(t), whorls(t))


@query(
    "cap_15_padded_positions",
    _CHO + ", k AS (SELECT image_id, whorl, count(*) AS n, count(*) FILTER (x = -1) AS g FROM c GROUP BY 1, 2) SELECT w.image_id, w.whorl, greatest(4, coalesce(n, 0)) AS n, coalesce(g, 0) + greatest(0, 4 - coalesce(n, 0)) AS missing FROM w LEFT JOIN k USING (image_id, whorl)",
)
def _(t):
    p = C.padded_positions(chomata(t), whorls(t))
    return p.select("image_id", "whorl", F.size("pos").cast("bigint").alias("n"), F.size(F.filter("pos", lambda s: s["x"] == -1)).cast("bigint").alias("missing"))


_TA = "((whorl * 7 + image_id) % 45)::DOUBLE"


@query(
    "cap_16_tunnel_features",
    _CHO
    + f""", a AS (SELECT image_id, whorl, {_TA} AS a, {case_in(_TA, _RT['tunnel_angle'])} AS c FROM h), e AS (SELECT image_id, arg_min(c, whorl) AS f, arg_max(c, whorl) AS l, round_even(avg(a), 0)::BIGINT AS mean_angle FROM a WHERE c <> '' GROUP BY 1),
    p AS (SELECT image_id, whorl, (x = -1 AND y = -1)::INT AS gone, CASE WHEN NOT (x = -1 AND y = -1) THEN atan2(y::DOUBLE, x::DOUBLE) END AS p FROM c),
    q AS (SELECT image_id, whorl, avg(gone) AS ms, min(p) FILTER (p >= 0) AS a0, max(p) FILTER (p >= 0) AS a1, min(p) FILTER (p < 0) AS a2, max(p) FILTER (p < 0) AS a3 FROM p GROUP BY 1, 2),
    s AS (SELECT image_id, avg(ms) AS ms, [x for x in [{', '.join(f'CASE WHEN count(a{i}) > 1 THEN stddev_pop(a{i}) END' for i in range(4))}] if x IS NOT NULL] AS sd FROM q GROUP BY 1),
    t AS (SELECT image_id, {case_in('avg(height)', _RT['chomata_height'])} AS th FROM c GROUP BY 1),
    u AS (SELECT *, CASE WHEN len(sd) > 0 THEN list_sum(sd) / len(sd) ELSE 1.0 END AS ir FROM s)
    SELECT image_id, mean_angle, 'Tunnels ' || th || CASE WHEN f = 'narrow' AND l = 'narrow' THEN ', narrow. ' WHEN f = 'narrow' AND l = 'broad' THEN ' and narrow in inner volutions, but broad in outer volutions. '
      WHEN f = 'broad' AND l = 'broad' THEN ', broad. ' WHEN f = 'moderate' AND l = 'broad' THEN ', broad in outer volutions and moderate in inner volutions. ' WHEN f = 'narrow' AND l = 'moderate' THEN ', narrow in inner volutions and moderate in outer volutions. '
      WHEN f = 'moderate' AND l = 'narrow' THEN ', narrower in outer volutions compared to inner volutions. ' WHEN f = 'broad' THEN ', broader in inner volutions compared to outer volutions. ' ELSE ', width moderate. ' END
      || 'Tunnel path ' || CASE WHEN {case_in('ms', _RT['tunnel_regular'])} = 'irregular' OR {case_in('ir', _RT['tunnel_regular'])} = 'irregular' THEN 'irregular' ELSE 'regular' END || '. ' AS shape
    FROM e JOIN u USING (image_id) JOIN t USING (image_id)""",
)
def _(t):
    a = whorls(t).select("image_id", "whorl", ((F.col("whorl") * 7 + F.col("image_id")) % 45).cast("double").alias("angle"))
    c = chomata(t)
    return C.tunnel_features(a, c, c.select("image_id", F.col("height").alias("rel_height")))


@query(
    "cap_17_filling_class",
    f"WITH x AS (SELECT p_partkey, p_size AS z, CASE p_size % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN ((p_size % 7 + 2) - 1) / (p_size % 10 + 5)::DOUBLE ELSE (0 - 999) / (p_size % 10 + 5)::DOUBLE END AS d FROM part) SELECT p_partkey, {case_in('d', _RT['deposit'])} AS filling FROM x",
)
def _(t):
    z = F.col("p_size")
    part = lambda k, a, b: F.struct(F.lit(k).alias("type"), a.cast("int").alias("start_volution"), b.cast("int").alias("end_volution"))
    fill = (
        F.when(z % 3 == 0, F.array().cast("array<struct<type:string,start_volution:int,end_volution:int>>"))
        .when(z % 3 == 1, F.array(part("main", z % 7 + 1 - z % 7, z % 4), part("main", F.lit(2), z % 7 + 2), part("ext", F.lit(0), F.lit(99))))
        .otherwise(F.array(part("ext", F.lit(1), F.lit(9))))
    )
    return t.part.select("p_partkey", C.filling_class(fill, z % 10 + 5).alias("filling"))


@query(
    "cap_18_proloculus",
    f"WITH x AS (SELECT p_partkey, p_size / 1024.0::DOUBLE * 1280.0::DOUBLE / (136.0::DOUBLE + p_partkey % 100) AS d FROM part) SELECT p_partkey, {case_in('d', _RT['proloculus_size'])} || ' spherical' AS shape, round_even(d, 2) AS diameter_mm FROM x",
)
def _(t):
    p = C.proloculus(F.col("p_size") / 1024.0, F.col("p_partkey") % 100)
    return t.part.select("p_partkey", p.alias("p")).select("p_partkey", "p.shape", "p.diameter_mm")


def _steps_sql(v, cuts_):
    return "CASE " + " ".join(f"WHEN {v} <= {float(c)!r}::DOUBLE THEN {i}" for i, c in enumerate(cuts_)) + " ELSE 3 END"


@query(
    "cap_19_septa_features",
    f"""WITH s AS (SELECT user_id AS image_id, event_id AS ord, CASE WHEN event_id % 5 = 0 THEN (event_id % 7 + 1)::INT END AS wh, value / 10000 AS size FROM events),
    f AS (SELECT image_id, ord, coalesce(last_value(wh IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY ord), 1) AS whorl, size FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id, whorl ORDER BY size, ord) - 1 AS i, count(*) OVER (PARTITION BY image_id, whorl) AS n FROM f),
    d AS (SELECT image_id, whorl, any_value(n) AS n, coalesce(sum(size * (2 * i - n + 1)) / nullif(any_value(n) * (any_value(n) - 1) / 2, 0), 0) AS diff FROM r GROUP BY 1, 2),
    h AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS t FROM d),
    a AS (SELECT image_id, any_value(t) AS t, coalesce(avg(diff) FILTER (whorl <= t / 2), 0) AS di, coalesce(avg(diff) FILTER (whorl > t / 2), 0) AS do_, coalesce(sum(n) FILTER (whorl <= t / 2), 0) AS fi, coalesce(sum(n) FILTER (whorl > t / 2), 0) AS fo FROM h GROUP BY 1),
    l AS (SELECT *, greatest({_steps_sql('(fi / (t / 2))', dims.SEPTA_COUNT_STEPS)}, {_steps_sql('di', dims.SEPTA_DIFF_STEPS)}) AS li, greatest({_steps_sql('(fo / (t / 2))', dims.SEPTA_COUNT_STEPS)}, {_steps_sql('do_', dims.SEPTA_DIFF_STEPS)}) AS lo FROM a)
    SELECT image_id, {R('di', 6)} AS di, {R('do_', 6)} AS "do", (['straight','slightly fluted','fluted','strongly fluted'])[li + 1] AS "inner", (['straight','slightly fluted','fluted','strongly fluted'])[lo + 1] AS "outer" FROM l""",
)
def _(t):
    e = F.col("event_id")
    s = t.events.select(F.col("user_id").alias("image_id"), e.alias("ord"), F.when(e % 5 == 0, (e % 7 + 1).cast("int")).alias("whorl"), (F.col("value") / 10000).alias("size"))
    return C.septa_features(s).select("image_id", rnd("di", 6).alias("di"), rnd("do", 6).alias("do"), "inner", "outer")


_CT = dims.CAPTION_ORDER + ["others"]


@query(
    "cap_20_order_tagged",
    "WITH e AS (SELECT user_id AS image_id, event_id % 17 AS k, min(event_id) AS m FROM events GROUP BY 1, 2) SELECT image_id, string_agg('<' || (['" + "','".join(_CT) + "'])[k + 1] || '>s' || m || '</' || (['" + "','".join(_CT) + "'])[k + 1] || '>', '' ORDER BY k) FILTER (k < 16) AS caption, count(*) FILTER (k = 16) AS rejected FROM e GROUP BY 1",
)
def _(t):
    tag = F.get(F.array(*[F.lit(x) for x in _CT]), (F.col("k")).cast("int"))
    e = t.events.groupBy(F.col("user_id").alias("image_id"), (F.col("event_id") % 17).alias("k")).agg(F.min("event_id").alias("m"))
    parts = e.select("image_id", F.concat(F.lit("<"), tag, F.lit(">s"), F.col("m").cast("string"), F.lit("</"), tag, F.lit(">")).alias("txt"))
    good, bad = C.order_tagged(parts)
    n = bad.groupBy("image_id").agg(F.count(F.lit(1)).alias("rejected"))
    return good.join(n, "image_id", "left").fillna(0, subset=["rejected"])
