"""GEO: shape geometry, enrichment and scene-quality filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scenemark.functions import geometry as G
from scenemark.functions.numeric import rnd
from scenemark.operators import scenes as Sc
from scenemark.operators.sampling import ordered_rank
from scenemark.plans.fixtures import SEQ, ctes
from scenemark.plans.registry import query
from scenemark.plans.vqa import shapes as scene_shapes
from scenemark.session import spread

KEY = ["image_id", "shape_idx"]


def R(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(38,12)), {n}) as double)"


# polygons: every vector's components in pairs, ordered by angle


def polygons(t):
    p = F.transform(
        F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1),
        lambda i: G.pt(F.get("embedding", 2 * i).cast("double") + 0.5, F.get("embedding", 2 * i + 1).cast("double") + 0.5),
    )
    return t.embeddings.select("vec_id", "label", G.simple_polygon(p).alias("points"))


_POLY = """WITH e AS (SELECT vec_id, label, [embedding[i]::DOUBLE + 0.5::DOUBLE for i in range(1, 65)] AS v FROM embeddings),
 q AS (SELECT vec_id, label, unnest(range(0, 32)) AS i, unnest([v[2 * k + 1] for k in range(0, 32)]) AS x, unnest([v[2 * k + 2] for k in range(0, 32)]) AS y FROM e),
 c AS (SELECT vec_id, (list_sum(list(x ORDER BY i))) / 32 AS mx, (list_sum(list(y ORDER BY i))) / 32 AS my FROM q GROUP BY 1),
 a AS (SELECT q.*, CASE WHEN atan2(y - my, x - mx) < 0 THEN atan2(y - my, x - mx) + 2 * pi() ELSE atan2(y - my, x - mx) END AS ang,
        -sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS d FROM q JOIN c USING (vec_id)),
 p AS (SELECT vec_id, label, x, y, row_number() OVER (PARTITION BY vec_id ORDER BY ang, d) - 1 AS k FROM a),
 n AS (SELECT p.*, q.x AS nx, q.y AS ny, r.x AS px, r.y AS py FROM p JOIN p q ON p.vec_id = q.vec_id AND q.k = (p.k + 1) % 32 JOIN p r ON p.vec_id = r.vec_id AND r.k = (p.k + 31) % 32)
"""


@query(
    "geo_02_03_polygon_area_centroid",
    _POLY
    + f""", s AS (SELECT vec_id, sum(x * ny - nx * y) / 2 AS a, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy FROM n GROUP BY 1)
    SELECT vec_id, {R('abs(a)', 6)} AS area, {R('sx / (6 * a)', 6)} AS cx, {R('sy / (6 * a)', 6)} AS cy,
     sx / (6 * a) > 0 AND sx / (6 * a) < 1 AND sy / (6 * a) > 0 AND sy / (6 * a) < 1 AS valid FROM s""",
)
def _(t):
    c = G.polygon_centroid("points")
    return polygons(t).select(
        "vec_id", rnd(G.polygon_area("points"), 6).alias("area"), rnd(c["x"], 6).alias("cx"), rnd(c["y"], 6).alias("cy"), c["valid"].alias("valid")
    )


@query(
    "geo_04_bbox",
    _POLY + "SELECT vec_id, min(x) AS min_x, max(y) AS max_y, max(x) AS max_x, min(y) AS min_y FROM p GROUP BY 1",
)
def _(t):
    return polygons(t).select("vec_id", G.bbox("points").alias("b")).select("vec_id", "b.*")


@query(
    "geo_19_simple_polygon",
    _POLY + f"SELECT vec_id, k::INT AS k, {R('x', 6)} AS x, {R('y', 6)} AS y FROM p",
)
def _(t):
    return polygons(t).select("vec_id", F.posexplode("points").alias("k", "p")).select(
        "vec_id", "k", rnd("p.x", 6).alias("x"), rnd("p.y", 6).alias("y")
    )


@query(
    "geo_15_polygon_valid",
    _POLY
    + """, g AS (SELECT *, (x - px) * (ny - py) - (y - py) * (nx - px) AS turn,
      acos(((x - px) * (x - nx) + (y - py) * (y - ny)) / (sqrt((x - px) * (x - px) + (y - py) * (y - py)) * sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) + 1e-9)) AS ang,
      CASE WHEN k < 31 THEN sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) END AS step FROM n)
    SELECT vec_id, NOT (max(turn) > 0 AND min(turn) < 0) AS convex, min(ang) >= 0.15 * pi() AND max(ang) <= 0.85 * pi() AS angles, min(step) >= 0.01 AS apart,
      NOT (max(turn) > 0 AND min(turn) < 0) AND min(ang) >= 0.15 * pi() AND max(ang) <= 0.85 * pi() AND min(step) >= 0.01 AS valid FROM g GROUP BY 1""",
)
def _(t):
    return polygons(t).select("vec_id", G.polygon_valid("points", F.lit("")).alias("v")).select("vec_id", "v.*")


@query(
    "geo_16_angles_distances",
    _POLY
    + f"""SELECT vec_id, k::INT AS k, {R('sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))', 6)} AS d,
      {R('CASE WHEN atan2(ny - y, nx - x) < 0 THEN atan2(ny - y, nx - x) + 2 * pi() ELSE atan2(ny - y, nx - x) END', 6)} AS polar,
      {R('degrees(acos(greatest(-1.0, least(1.0, ((px - x) * (nx - x) + (py - y) * (ny - y)) / (sqrt((px - x) * (px - x) + (py - y) * (py - y)) * sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)))))))', 6)} AS angle FROM n""",
)
def _(t):
    p = polygons(t).withColumn("n", G.rotate(F.col("points"))).withColumn(
        "q", F.concat(F.slice("points", -1, 1), F.slice("points", F.lit(1), F.size("points") - 1))
    )
    z = p.select("vec_id", F.posexplode(F.arrays_zip("points", "n", "q")).alias("k", "z"))
    a, b, c = F.col("z.points"), F.col("z.n"), F.col("z.q")
    return z.select(
        "vec_id", "k", rnd(G.dist(a, b), 6).alias("d"), rnd(G.polar_angle(a, b), 6).alias("polar"), rnd(G.vertex_angle(a, c, b), 6).alias("angle")
    )


# raw scene records from line items: every shape family


_RAW = ["polygon", "segment", "ellipse", "spiral", "sector", "star", "ray"]
TAU = 2 * math.pi


def raw_shapes(t):
    """(image_id, shape_idx, shape) with the wide shape struct."""
    li = spread(t.lineitem)
    x, y = (F.col("l_partkey") % 97 + 1) / 100.0, (F.col("l_suppkey") % 89 + 5) / 100.0
    w = (F.round(F.col("l_discount") * 100).cast("int") * 2 + 6) / 100.0
    h = (F.round(F.col("l_tax") * 100).cast("int") * 2 + 4) / 100.0
    a0 = (F.col("l_quantity") % 12) / 2.0
    n = (F.col("l_suppkey") % 4 + 3).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in _RAW]), (F.col("l_partkey") % 7 + 1).cast("int"))
    ring = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: G.pt(x + w * F.cos(i * F.lit(TAU) / n + 0.1), y + h * F.sin(i * F.lit(TAU) / n + 0.1))
    )
    line = F.array(G.pt(x, y), G.pt(x + w, y - h))
    is_ = lambda *ks: kind.isin(*ks)
    null = F.lit(None).cast("double")
    shape = F.struct(
        kind.alias("type"),
        F.when(is_("polygon"), ring).when(is_("segment", "ray"), line).alias("points"),
        G.pt(x, y).alias("center"),
        F.when(is_("ellipse"), w).otherwise(null).alias("major_axis"),
        F.when(is_("ellipse"), h).otherwise(null).alias("minor_axis"),
        F.when(is_("ellipse", "star"), a0).otherwise(null).alias("rotation"),
        (w / 10.0).alias("initial_radius"),
        (h / 20.0).alias("growth_rate"),
        F.array(F.lit(0.001), F.lit(2.0), a0).alias("sin_params"),
        (8.0 + a0).alias("max_theta"),
        w.alias("radius"),
        a0.alias("start_angle"),
        (a0 * 2.0 + 1.0).alias("end_angle"),
        (w + 0.1).alias("outer_radius"),
        (w / 2.0).alias("inner_radius"),
        (n + 1).alias("num_points"),
        F.when(is_("ellipse") & (F.col("l_suppkey") % 5 == 0), "circle ").otherwise("").alias("special_info"),
        F.lit("no").alias("fill_mode"),
    )
    return li.select(F.col("l_orderkey").alias("image_id"), F.expr(SEQ).alias("shape_idx"), shape.alias("shape"))


# closed forms over the same scenes, row by row in SQL; rounded half-even to 4 places
_SPIRAL = "(w / 10 + (h / 20 + 0.001::DOUBLE * sin(2.0::DOUBLE * {t} + a0)) * {t})"
_ENRICH = f"""WITH r AS (SELECT l_orderkey AS image_id, {SEQ} AS shape_idx, (['polygon','segment','ellipse','spiral','sector','star','ray'])[l_partkey % 7 + 1] AS kind,
  (l_partkey % 97 + 1)::DOUBLE / 100 AS x, (l_suppkey % 89 + 5)::DOUBLE / 100 AS y, (round(l_discount * 100)::INT * 2 + 6)::DOUBLE / 100 AS w,
  (round(l_tax * 100)::INT * 2 + 4)::DOUBLE / 100 AS h, (l_quantity % 12) / 2 AS a0, (l_suppkey % 4 + 3)::INT AS n, l_suppkey FROM lineitem),
 t AS (SELECT *, CASE kind WHEN 'polygon' THEN (['triangle','quadrilateral','pentagon','hexagon'])[n - 2] WHEN 'segment' THEN 'line' WHEN 'ray' THEN 'line'
   WHEN 'ellipse' THEN CASE WHEN l_suppkey % 5 = 0 THEN 'circle' ELSE 'ellipse' END ELSE kind END AS type,
   a0 - 2 * pi() * floor(a0 / (2 * pi())) AS s0, (a0 * 2 + 1) - 2 * pi() * floor((a0 * 2 + 1) / (2 * pi())) AS e0, greatest(0.0::DOUBLE, 8 + a0 - 2 * pi()) AS th0, 8 + a0 AS th1 FROM r),
 u AS (SELECT *, CASE WHEN e0 <= s0 THEN e0 + 2 * pi() - s0 ELSE e0 - s0 END AS span, (th1 - th0) / 200 AS st FROM t),
 b AS (SELECT *, CASE kind
   WHEN 'polygon' THEN abs(list_sum([(x + w * cos(2 * pi() * i / n + 0.1)) * (y + h * sin(2 * pi() * (i + 1) / n + 0.1)) - (x + w * cos(2 * pi() * (i + 1) / n + 0.1)) * (y + h * sin(2 * pi() * i / n + 0.1)) for i in range(0, n)])) / 2
   WHEN 'ellipse' THEN pi() * w * h / 4
   WHEN 'sector' THEN 0.5 * w * w * span
   WHEN 'star' THEN (w + 0.1) * (w / 2) * (n + 1) * sin(pi() / (n + 1))
   WHEN 'spiral' THEN list_sum([(CASE WHEN i = 0 OR i = 200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.5 * pow({_SPIRAL.format(t='(th0 + i * st)')}, 2) for i in range(0, 201)]) * st / 3
   ELSE 0.0 END AS area,
   CASE kind WHEN 'polygon' THEN x WHEN 'sector' THEN x + (2.0::DOUBLE / 3) * w * sin(span / 2) / (span / 2) * cos(s0 + span / 2) WHEN 'segment' THEN x + w / 2 WHEN 'ray' THEN x + w / 2 ELSE x END AS cx,
   CASE kind WHEN 'polygon' THEN y WHEN 'sector' THEN y + (2.0::DOUBLE / 3) * w * sin(span / 2) / (span / 2) * sin(s0 + span / 2) WHEN 'segment' THEN y - h / 2 WHEN 'ray' THEN y - h / 2 ELSE y END AS cy,
   CASE kind
    WHEN 'polygon' THEN list_max([x + w * cos(2 * pi() * i / n + 0.1) for i in range(0, n)])
    WHEN 'ellipse' THEN x + sqrt(w * w * cos(a0) * cos(a0) + h * h * sin(a0) * sin(a0)) / 2
    WHEN 'star' THEN list_max([x + (CASE WHEN i % 2 = 0 THEN w + 0.1 ELSE w / 2 END) * cos(a0 + i * pi() / (n + 1)) for i in range(0, 2 * n + 2)])
    WHEN 'sector' THEN greatest(x, x + w * cos(s0), x + w * cos(s0 + span), CASE WHEN s0 + span > 2 * pi() THEN x + w ELSE x END)
    WHEN 'spiral' THEN list_max([x + {_SPIRAL.format(t='(i * (th1 / 999))')} * cos(i * (th1 / 999)) for i in range(0, 1000)])
    ELSE x + w END AS max_x FROM u)
"""


@query(
    "geo_01_05_09_20_enrich",
    _ENRICH + f"SELECT image_id, shape_idx, type, {R('cx', 4)} AS cx, {R('cy', 4)} AS cy, {R('area', 4)} AS area, {R('max_x', 4)} AS max_x FROM b",
)
def _(t):
    s = F.col("shape")
    c, b = G.shape_center(s), G.shape_box(s)
    e = raw_shapes(t).select(
        *KEY, G.shape_type(s["type"], s["special_info"], F.size(s["points"])).alias("type"), c.alias("c"), b.alias("b"), G.shape_area(s).alias("area")
    )
    return e.select(*KEY, "type", rnd("c.x", 4).alias("cx"), rnd("c.y", 4).alias("cy"), rnd("area", 4).alias("area"), rnd("b.max_x", 4).alias("max_x"))


@query(
    "geo_20_type_counts",
    _ENRICH + "SELECT image_id, type, count(*) AS n FROM t GROUP BY 1, 2",
)
def _(t):
    s = F.col("shape")
    typed = raw_shapes(t).select("image_id", G.shape_type(s["type"], s["special_info"], F.size(s["points"])).alias("type"))
    return Sc.type_counts(typed)


_EV = lambda x: f"(round_even({x}, 2) + 0.0)"


@query(
    "geo_20_enrich_rounded",
    _ENRICH + f"SELECT image_id, shape_idx, type, {_EV('cx')} AS cx, {_EV('cy')} AS cy, {_EV('area')} AS area, {_EV('max_x')} AS max_x FROM b",
)
def _(t):
    """The enrichment as written out, rounded half-even to two places."""
    e = Sc.enrich(raw_shapes(t))
    return e.select(*KEY, "type", *[(F.col(c) + 0.0).alias(n) for c, n in (("center.x", "cx"), ("center.y", "cy"), ("area", "area"), ("box.max_x", "max_x"))])


_GON = "((w / 10 + h / 20 * (th1 - 2 * pi() + ({i}) * (2 * pi() / 360))) * {f}(th1 - 2 * pi() + ({i}) * (2 * pi() / 360)))"
_GON_LENGTH = "list_sum([sqrt(" + " + ".join(
    f"pow({_GON.format(i='(i + 1) % 360', f=f)} - {_GON.format(i='i', f=f)}, 2)" for f in ("cos", "sin")
) + ") for i in range(0, 360)])"


@query(
    "geo_18_perimeter",
    _ENRICH
    + f""", k AS (SELECT *, 2 * pi() / 4000 AS d FROM u)
    SELECT image_id, shape_idx, {R('''CASE kind WHEN 'ray' THEN sqrt(w * w + h * h) WHEN 'segment' THEN 2 * sqrt(w * w + h * h)
      WHEN 'polygon' THEN list_sum([sqrt(pow(w * cos(2 * pi() * (i + 1) / n + 0.1) - w * cos(2 * pi() * i / n + 0.1), 2) + pow(h * sin(2 * pi() * (i + 1) / n + 0.1) - h * sin(2 * pi() * i / n + 0.1), 2)) for i in range(0, n)])
      WHEN 'spiral' THEN GON_LENGTH
      WHEN 'sector' THEN 0.0 WHEN 'star' THEN 0.0
      ELSE list_sum([sqrt(pow(w * sin((i + 0.5) * 2 * pi() / 64), 2) + pow(h * cos((i + 0.5) * 2 * pi() / 64), 2)) for i in range(0, 64)]) * 2 * pi() / 64 END'''.replace('GON_LENGTH', _GON_LENGTH), 3)} AS weight FROM k""",
)
def _(t):
    return raw_shapes(t).select(*KEY, rnd(G.perimeter(F.col("shape")), 3).alias("weight"))


@query(
    "geo_17_round_struct",
    "SELECT vec_id, round_even(embedding[1]::DOUBLE + 0.5::DOUBLE, 2) AS x, array_to_string([(round_even(e::DOUBLE, 2) + 0.0)::VARCHAR for e in embedding], '|') AS v FROM embeddings",
)
def _(t):
    from pyspark.sql import types as T

    nested = F.struct(
        (F.get("embedding", 0).cast("double") + 0.5).alias("x"), F.transform("embedding", lambda e: e.cast("double")).alias("v")
    )
    dt = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    r = t.embeddings.select("vec_id", G.round_struct(nested, dt, 2).alias("r"))
    return r.select("vec_id", "r.x", F.array_join(F.transform("r.v", lambda e: (e + 0.0).cast("string")), "|").alias("v"))


# boxes of the scene shapes

_S = ctes("shapes", s="SELECT image_id, shape_idx, min_x::DOUBLE AS min_x, max_y::DOUBLE AS max_y, max_x::DOUBLE AS max_x, min_y::DOUBLE AS min_y FROM shapes")
_OV = "(greatest(0.0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * greatest(0.0, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)))"
_AR = lambda t: f"(({t}.max_x - {t}.min_x) * ({t}.max_y - {t}.min_y))"


@query(
    "geo_10_11_overlap_sums",
    _S
    + f""", p AS (SELECT b.image_id, b.shape_idx, {_OV} / ({_AR('a')} + {_AR('b')} - {_OV}) AS iou FROM s a JOIN s b ON a.image_id = b.image_id AND a.shape_idx < b.shape_idx),
    g AS (SELECT image_id, shape_idx, sum(iou) AS iou FROM p GROUP BY 1, 2)
    SELECT s.image_id, s.shape_idx, {R('coalesce(iou, 0)', 6)} AS iou_sum FROM s LEFT JOIN g USING (image_id, shape_idx)""",
)
def _(t):
    return Sc.overlap_sums(scene_shapes(t)).select(*KEY, rnd("iou_sum", 6).alias("iou_sum"))


@query(
    "geo_11_no_overlap",
    _S
    + f""", p AS (SELECT b.image_id, b.shape_idx, {_OV} / ({_AR('a')} + {_AR('b')} - {_OV}) AS iou FROM s a JOIN s b ON a.image_id = b.image_id AND a.shape_idx < b.shape_idx),
    g AS (SELECT image_id, shape_idx, sum(iou) AS iou FROM p GROUP BY 1, 2)
    SELECT s.image_id, s.shape_idx FROM s LEFT JOIN g USING (image_id, shape_idx) WHERE coalesce(iou, 0) <= 0.2""",
)
def _(t):
    return Sc.no_overlap(scene_shapes(t)).select(*KEY)


@query(
    "geo_12_in_canvas",
    _S + f"SELECT image_id, shape_idx FROM s WHERE greatest(0.0, least(max_x, 1.0) - greatest(min_x, 0.0)) * greatest(0.0, least(max_y, 1.0) - greatest(min_y, 0.0)) / {_AR('s')} >= 0.8",
)
def _(t):
    return Sc.in_canvas(scene_shapes(t)).select(*KEY)


def _rings(t):
    """Closed rings for the crossing test: three to six points around the centre."""
    s = scene_shapes(t)
    n = (F.col("shape_idx") % 4 + 3).cast("int")
    b = F.col("box")
    w, h = (b["max_x"] - b["min_x"]) / 2.0, (b["max_y"] - b["min_y"]) / 2.0
    ring = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: G.pt(F.col("cx") + w * F.cos(i * F.lit(TAU) / n), F.col("cy") + h * F.sin(i * F.lit(TAU) / n))
    )
    return s.select(*KEY, ring.alias("points"))


_RINGS = ctes(
    "shapes",
    s="SELECT image_id, shape_idx, cx::DOUBLE AS cx, cy::DOUBLE AS cy, (max_x::DOUBLE - min_x::DOUBLE) / 2 AS w, (max_y::DOUBLE - min_y::DOUBLE) / 2 AS h, (shape_idx % 4 + 3)::INT AS n FROM shapes",
    v="SELECT *, unnest(range(0, n)) AS i FROM s",
    e="SELECT image_id, shape_idx, cx + w * cos(i * (2 * pi()) / n) AS x1, cy + h * sin(i * (2 * pi()) / n) AS y1, cx + w * cos(((i + 1) % n) * (2 * pi()) / n) AS x2, cy + h * sin(((i + 1) % n) * (2 * pi()) / n) AS y2 FROM v",
    j="SELECT b.image_id, b.shape_idx, a.x2 - a.x1 AS ax, a.y2 - a.y1 AS ay, b.x2 - b.x1 AS bx, b.y2 - b.y1 AS by_, b.x1 - a.x1 AS cx, b.y1 - a.y1 AS cy FROM e a JOIN e b ON a.image_id = b.image_id AND a.shape_idx < b.shape_idx",
    d="SELECT *, ax * by_ - ay * bx AS det, CASE WHEN ax * ax + ay * ay > 0 THEN (cx * ax + cy * ay) / (ax * ax + ay * ay) ELSE 0 END AS t0, CASE WHEN ax * ax + ay * ay > 0 THEN (cx * ax + cy * ay) / (ax * ax + ay * ay) + (bx * ax + by_ * ay) / (ax * ax + ay * ay) ELSE 0 END AS t1 FROM j",
    x="""SELECT image_id, shape_idx, CASE WHEN abs(det) < 1e-9 THEN abs(cy * ax - cx * ay) < 1e-9 AND greatest(0, least(t0, t1)) <= least(1, greatest(t0, t1))
      ELSE (cx * ay - cy * ax) / det BETWEEN -0.1 AND 1.1 AND (cx * by_ - cy * bx) / det BETWEEN -0.1 AND 1.1 END AS hit FROM d""",
    g="SELECT image_id, shape_idx, sum(hit::INT)::BIGINT AS n FROM x GROUP BY 1, 2",
)


@query("geo_13_14_crossings", _RINGS + "SELECT s.image_id, s.shape_idx, coalesce(g.n, 0) AS crossings FROM s LEFT JOIN g USING (image_id, shape_idx)")
def _(t):
    return Sc.crossings(_rings(t))


@query("geo_14_valid_intersection", _RINGS + "SELECT s.image_id, s.shape_idx FROM s LEFT JOIN g USING (image_id, shape_idx) WHERE coalesce(g.n, 0) <= 1")
def _(t):
    return Sc.valid_intersection(_rings(t)).select(*KEY)


# point series


@query(
    "geo_21_unique_x",
    """WITH p AS (SELECT user_id * 100 + event_id % 40 AS id, event_id AS seq, floor(value / 20)::INT AS x, value AS y FROM events),
    f AS (SELECT id, x, min(seq) AS seq, arg_min(y, seq) AS y FROM p GROUP BY 1, 2), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM f)
    SELECT id, x, seq, y FROM c UNION ALL SELECT id, x + d, seq, y FROM c, (SELECT unnest([-1, 1]) AS d) WHERE n = 1""",
)
def _(t):
    p = t.events.select(
        (F.col("user_id") * 100 + F.col("event_id") % 40).alias("id"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 20).cast("int").alias("x"), F.col("value").alias("y")
    )
    return Sc.unique_x(p).select("id", "x", "seq", "y")


@query(
    "geo_22_smooth",
    f"""SELECT event_id, {R('''CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 THEN value ELSE avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END''', 6)} AS smoothed FROM events""",
)
def _(t):
    e = ordered_rank(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), ["event_id"], "seq")
    return Sc.smooth(e, "user_id", "seq", "value").select("event_id", rnd("smoothed", 6).alias("smoothed"))


@query(
    "geo_23_real_area",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('(l_quantity - 1) * (p_size / 100.0::DOUBLE) * (p_size / 100.0::DOUBLE)', 6)} AS area
     FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 9 <> 0) ON l_partkey = p_partkey WHERE l_quantity > 1""",
)
def _(t):
    areas = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("image"), (F.col("l_quantity") - 1).alias("pixel_area"))
    cat = t.part.filter("p_size % 9 <> 0").select(F.col("p_partkey").alias("image"), (F.col("p_size") / 100.0).alias("scale"))
    return Sc.real_area(areas, cat).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("area", 6).alias("area"))


@query(
    "geo_24_curve_box",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0::DOUBLE ELSE p_size / 20.0::DOUBLE END AS min_x, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE + p_size / 100.0::DOUBLE / 2 ELSE 0.75::DOUBLE END AS max_y,
     CASE WHEN p_size % 2 = 0 THEN p_size / 10.0::DOUBLE + 1 ELSE 9.0 END AS max_x, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE - p_size / 100.0::DOUBLE / 2 ELSE 0.25::DOUBLE END AS min_y FROM part""",
)
def _(t):
    z = F.col("p_size")
    kind = F.when(z % 2 == 0, "fusiform_1").otherwise("curves")
    v = F.array(G.pt(9.0, 0.5), G.pt(1.0, 0.75), G.pt(z / 20.0, 0.5), G.pt(1.0, 0.25))
    b = G.curve_box(kind, z / 10.0, z / 10.0 + 1, F.lit(0.5), z / 100.0, v)
    return t.part.select("p_partkey", b.alias("b")).select("p_partkey", "b.*")
