"""Shape geometry as column expressions.

Points are ``struct<x,y>``, boxes ``struct<min_x,max_y,max_x,min_y>`` with y upwards.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemark import dims
from scenemark.functions.answers import let
from scenemark.functions.rnd import _c

PI, TAU = math.pi, 2 * math.pi


def pt(x, y) -> Column:
    return F.struct(_num(x).alias("x"), _num(y).alias("y"))


def _num(v) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else _c(v)


def box(min_x, max_y, max_x, min_y) -> Column:
    return F.struct(
        _num(min_x).alias("min_x"), _num(max_y).alias("max_y"), _num(max_x).alias("max_x"), _num(min_y).alias("min_y")
    )


def sum_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def rotate(p: Column) -> Column:
    """Points shifted by one: the successor of every vertex."""
    return F.concat(F.slice(p, F.lit(2), F.size(p)), F.slice(p, 1, 1))


def flat_points(points) -> Column:
    """Points as one array x, y, x, y, …"""
    return F.flatten(F.transform(_c(points), lambda p: F.array(p["x"], p["y"])))


def points_of(flat: Column) -> Column:
    """Points of a flat array."""
    steps = F.sequence(F.lit(0), F.lit(2) * (F.size(flat) / 2).cast("int") - 2, F.lit(2))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.when(F.size(flat) >= 2, F.transform(steps, lambda i: pt(F.get(flat, i), F.get(flat, i + 1)))).when(flat.isNotNull(), none)


def ordinary(flat: Column) -> Column:
    """Whether a flat array has points, and all coordinates are numbers of ordinary size."""
    return F.coalesce((F.size(flat) > 0) & F.forall(flat, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False))


#: Doubles that a step over many pairs of point sequences holds at once.
AT_ONCE = 1 << 20


def of_pairs(many, one):
    """Column function of two structs of ``flat`` and ``fine``, a flat point array and whether it is
    ordinary: ``many`` takes arrays (pair, point, 2) of pairs with equal numbers of points and gives
    a number each; other pairs go to the column function ``one`` of two point arrays."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        sides = []
        for s in (a, b):
            sizes = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sides.append((s.flatten().to_numpy(zero_copy_only=False), sizes, np.cumsum(sizes) - sizes))
        out = np.full(len(a), np.nan)
        kinds = sides[0][1] << 32 | sides[1][1]
        for kind in np.unique(kinds):
            m, n = int(kind >> 32), int(kind & 0xFFFFFFFF)
            if not m or not n:
                continue
            rows = np.flatnonzero(kinds == kind)
            step = max(1, AT_ONCE // (m * n))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                p, q = (v[at[some][:, None] + np.arange(size)].reshape(len(some), -1, 2) for (v, _, at), size in zip(sides, (m, n)))
                out[some] = many(p, q)
        return pa.array(out, mask=np.isnan(out))

    def of(a: Column, b: Column) -> Column:
        fine = F.coalesce(a["fine"] & b["fine"], F.lit(False))
        odd = one(points_of(F.when(~fine, a["flat"])), points_of(F.when(~fine, b["flat"])))
        return F.when(fine, run(F.when(fine, a["flat"]), F.when(fine, b["flat"]))).otherwise(odd.cast("double"))

    return of


# --- measures ------------------------------------------------------------------------


def dist(p: Column, q: Column) -> Column:
    """GEO-16: distance of two points."""
    return F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))


def polar_angle(p: Column, q: Column) -> Column:
    """GEO-16: direction from p to q in [0, 2π)."""
    return let(
        F.atan2(q["y"] - p["y"], q["x"] - p["x"]), lambda a: F.when(a < 0, a + F.lit(TAU)).otherwise(a)
    )


def vertex_angle(v: Column, a: Column, b: Column) -> Column:
    """GEO-16: angle at v between a and b, in degrees; NULL if a side has no length."""
    dot = (a["x"] - v["x"]) * (b["x"] - v["x"]) + (a["y"] - v["y"]) * (b["y"] - v["y"])
    cos = F.try_divide(dot, dist(v, a) * dist(v, b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))) + F.when(
        cos.isNull(), F.lit(None).cast("double")
    ).otherwise(0.0)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(points) -> Column:
    p = _c(points)
    return sum_of(F.zip_with(p, rotate(p), _cross)) / 2.0


def polygon_area(points) -> Column:
    """GEO-2."""
    return F.abs(signed_area(points))


def polygon_centroid(points) -> Column:
    """GEO-3: struct(x, y, valid); valid means strictly inside the unit canvas."""
    p = _c(points)
    terms = F.zip_with(
        p,
        rotate(p),
        lambda a, b: F.struct(
            _cross(a, b).alias("c"),
            ((a["x"] + b["x"]) * _cross(a, b)).alias("x"),
            ((a["y"] + b["y"]) * _cross(a, b)).alias("y"),
        ),
    )

    def centre(t):
        a3 = sum_of(F.transform(t, lambda s: s["c"])) * 3.0
        return F.struct(
            F.try_divide(sum_of(F.transform(t, lambda s: s["x"])), a3).alias("x"),
            F.try_divide(sum_of(F.transform(t, lambda s: s["y"])), a3).alias("y"),
        )

    return let(
        let(terms, centre),
        lambda c: F.struct(
            c["x"].alias("x"),
            c["y"].alias("y"),
            F.coalesce((c["x"] > 0) & (c["x"] < 1) & (c["y"] > 0) & (c["y"] < 1), F.lit(False)).alias("valid"),
        ),
    )


def mean_point(points) -> Column:
    p = _c(points)
    n = F.size(p)
    return pt(sum_of(F.transform(p, lambda s: s["x"])) / n, sum_of(F.transform(p, lambda s: s["y"])) / n)


def bbox(points) -> Column:
    """GEO-4."""
    p = _c(points)
    xs, ys = F.transform(p, lambda s: s["x"]), F.transform(p, lambda s: s["y"])
    return box(F.array_min(xs), F.array_max(ys), F.array_max(xs), F.array_min(ys))


def line_length(points) -> Column:
    """GEO-5."""
    p = _c(points)
    return dist(F.get(p, 0), F.get(p, 1))


def ellipse_area(major, minor) -> Column:
    """GEO-6."""
    return F.lit(PI) * _c(major) * _c(minor) / 4.0


def ellipse_box(center, major, minor, rotation) -> Column:
    """GEO-6: closed-form box of a rotated ellipse."""
    c, a, b, t = _c(center), _c(major), _c(minor), _c(rotation)
    hx = F.sqrt(a * a * F.cos(t) * F.cos(t) + b * b * F.sin(t) * F.sin(t)) / 2.0
    hy = F.sqrt(a * a * F.sin(t) * F.sin(t) + b * b * F.cos(t) * F.cos(t)) / 2.0
    return box(c["x"] - hx, c["y"] + hy, c["x"] + hx, c["y"] - hy)


def _turn(a: Column) -> Column:
    return F.pmod(a, F.lit(TAU))


def sector_span(start, end) -> Column:
    """GEO-7: angular span in (0, 2π]."""
    s, e = _turn(_c(start)), _turn(_c(end))
    return F.when(e <= s, e + TAU - s).otherwise(e - s)


def sector_area(radius, start, end) -> Column:
    return 0.5 * _c(radius) * _c(radius) * sector_span(start, end)


def sector_centroid(center, radius, start, end) -> Column:
    c, r, h = _c(center), _c(radius), sector_span(start, end) / 2.0
    d = F.lit(2.0 / 3.0) * r * F.sin(h) / h
    mid = _turn(_c(start)) + h
    return pt(c["x"] + d * F.cos(mid), c["y"] + d * F.sin(mid))


def sector_box(center, radius, start, end) -> Column:
    """Box of centre, arc ends and the axis directions inside the arc."""
    c, r = _c(center), _c(radius)

    def build(v):
        s, span = v["s"], v["span"]
        axes = F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k * F.lit(PI / 2)), lambda a: (a > s) & (a < s + span)
        )
        angles = F.concat(F.array(s, s + span), axes)
        arc = F.transform(angles, lambda a: pt(c["x"] + r * F.cos(a), c["y"] + r * F.sin(a)))
        return bbox(F.concat(F.array(pt(c["x"], c["y"])), arc))

    return let(F.struct(_turn(_c(start)).alias("s"), sector_span(start, end).alias("span")), build)


def star_points(center, outer, inner, n, rotation) -> Column:
    """GEO-8: alternating outer and inner vertices."""
    c, t, k = _c(center), _c(rotation), _c(n)

    def vertex(i):
        a = t + i * (F.lit(PI) / k)
        r = F.when(i % 2 == 0, _c(outer)).otherwise(_c(inner))
        return pt(c["x"] + r * F.cos(a), c["y"] + r * F.sin(a))

    return F.transform(F.sequence(F.lit(0), 2 * k - 1), vertex)


def spiral_radius(theta: Column, r0, growth, params) -> Column:
    """GEO-9: r0 + (g + ε·sin(ωθ + φ))·θ."""
    p = _c(params)
    return _c(r0) + (_c(growth) + F.get(p, 0) * F.sin(F.get(p, 1) * theta + F.get(p, 2))) * theta


def _spiral_angles(max_theta: Column, r0, growth, params) -> list[Column]:
    p = _c(params)
    return [c.cast("double") for c in (_c(r0), _c(growth), F.get(p, 0), F.get(p, 1), F.get(p, 2), max_theta)]


def _radii(theta: np.ndarray, r0, growth, wave, freq, phase) -> np.ndarray:
    """``spiral_radius`` of every row (first axis) at its angles (second axis)."""
    col = lambda v: v[:, None]
    return col(r0) + (col(growth) + col(wave) * np.sin(col(freq) * theta + col(phase))) * theta


def _spirals(values: tuple[pd.Series, ...], width: int, fill) -> pd.DataFrame:
    """``fill(arrays)``, one row of ``width`` numbers per spiral, for the rows that hold one; the
    samples of a few hundred spirals are in memory at once."""
    v = np.stack([c.to_numpy("float64", na_value=np.nan) for c in values])
    out = np.full((v.shape[1], width), np.nan)
    have = np.flatnonzero(~np.isnan(v).any(0))
    for k in range(0, len(have), 256):
        some = have[k : k + 256]
        out[some] = fill(*v[:, some])
    return pd.DataFrame(out)


def _spiral_reach(samples: int):
    @F.pandas_udf("struct<min_x:double,max_y:double,max_x:double,min_y:double>")
    def reach(r0: pd.Series, growth: pd.Series, wave: pd.Series, freq: pd.Series, phase: pd.Series, end: pd.Series) -> pd.DataFrame:
        def fill(r0, growth, wave, freq, phase, end):
            th = np.arange(samples) * (end / float(samples - 1))[:, None]
            r = _radii(th, r0, growth, wave, freq, phase)
            x, y = r * np.cos(th), r * np.sin(th)
            return np.stack([x.min(1), y.max(1), x.max(1), y.min(1)], 1)

        return _spirals((r0, growth, wave, freq, phase, end), 4, fill).set_axis(["min_x", "max_y", "max_x", "min_y"], axis=1)

    return reach


def spiral_box(center, r0, growth, params, max_theta, samples: int = 1000) -> Column:
    """Box of ``samples`` points along the spiral.  Their extremes around the origin are found for
    a batch of spirals at a time; adding the centre keeps the order of the sums."""
    c, known = _c(center), _spiral_angles(_c(max_theta), r0, growth, params)
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in known])
    return let(
        F.when(whole, _spiral_reach(samples)(*known)),
        lambda e: box(c["x"] + e["min_x"], c["y"] + e["max_y"], c["x"] + e["max_x"], c["y"] + e["min_y"]),
    )


def _simpson(intervals: int):
    @F.pandas_udf("double")
    def total(r0: pd.Series, growth: pd.Series, wave: pd.Series, freq: pd.Series, phase: pd.Series, end: pd.Series) -> pd.Series:
        def fill(r0, growth, wave, freq, phase, end):
            start = np.maximum(0.0, end - TAU)
            h = (end - start) / float(intervals)
            i = np.arange(intervals + 1)
            weight = np.where((i == 0) | (i == intervals), 1.0, np.where(i % 2 == 1, 4.0, 2.0))
            th = start[:, None] + i * h[:, None]
            terms = weight * 0.5 * np.square(_radii(th, r0, growth, wave, freq, phase))
            # added one after the other, as a fold over the intervals does
            return (np.cumsum(terms, 1)[:, -1] * h / 3.0)[:, None]

        return _spirals((r0, growth, wave, freq, phase, end), 1, fill)[0]

    return total


def spiral_area(r0, growth, params, max_theta, intervals: int = 200) -> Column:
    """½∫r² over the last turn by Simpson's rule."""
    known = _spiral_angles(_c(max_theta), r0, growth, params)
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in known])
    return F.when(whole, _simpson(intervals)(*known))


# --- boxes ---------------------------------------------------------------------------


def box_area(b: Column) -> Column:
    return (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])


def overlap_area(a: Column, b: Column) -> Column:
    """GEO-10."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """GEO-11: intersection over union; NULL for two empty boxes."""
    inter = overlap_area(a, b)
    return F.try_divide(inter, box_area(a) + box_area(b) - inter)


def canvas_ratio(b: Column) -> Column:
    """GEO-12: share of a box inside the unit canvas."""
    return F.try_divide(overlap_area(b, box(0, 1, 1, 0)), box_area(b))


def curve_box(kind, x_start, x_end, y_mid, height, vertices) -> Column:
    """GEO-24: box of fusiform (stored extents) and closed-curve (extreme vertices) shapes."""
    v = _c(vertices)
    fus = box(_c(x_start), _c(y_mid) + _c(height) / 2.0, _c(x_end), _c(y_mid) - _c(height) / 2.0)
    cur = box(F.get(v, 2)["x"], F.get(v, 1)["y"], F.get(v, 0)["x"], F.get(v, 3)["y"])
    return F.when(_c(kind).contains("fusiform"), fus).when(_c(kind) == "curves", cur)


# --- segments and polygons ---------------------------------------------------------------


def segments_intersect(p1: Column, p2: Column, p3: Column, p4: Column, slack: float = 0.1) -> Column:
    """GEO-13: whether two segments cross, each reaching ``slack`` of its length beyond its ends.

    The cross product of the directions is how far the lines turn; twice the signed area of the
    triangle over a segment and the other's first end, over that turn, is where on the other the
    lines meet.  Collinear segments must overlap, without slack; a first segment without length
    must be where the second begins."""

    def cross(a, b, c, d):
        """Of the vectors a to b and c to d."""
        return (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])

    sides = F.struct(cross(p1, p2, p3, p4).alias("turn"), cross(p3, p4, p3, p1).alias("first"), cross(p1, p2, p1, p3).alias("second"))

    def meet(axis):
        low = F.greatest(F.least(p1[axis], p2[axis]), F.least(p3[axis], p4[axis]))
        high = F.least(F.greatest(p1[axis], p2[axis]), F.greatest(p3[axis], p4[axis]))
        return low <= high + 1e-12  # ends that touch may differ by rounding

    def test(s):
        inside = lambda at: at.between(-slack, 1 + slack)
        crossing = inside(F.try_divide(s["first"], s["turn"])) & inside(F.try_divide(-s["second"], s["turn"]))
        point = (p1["x"] == p2["x"]) & (p1["y"] == p2["y"])
        along = F.when(point, (p1["x"] == p3["x"]) & (p1["y"] == p3["y"])).otherwise(meet("x") & meet("y"))
        return F.when(F.abs(s["turn"]) >= 1e-9, crossing).otherwise((F.abs(s["second"]) < 1e-9) & along)

    return let(sides, test)


def polygon_valid(points, special_info) -> Column:
    """GEO-15: struct of the checks a generated polygon must pass, and their conjunction."""
    p, info = _c(points), F.coalesce(_c(special_info), F.lit(""))
    nxt, prv = rotate(p), F.concat(F.slice(p, -1, 1), F.slice(p, F.lit(1), F.size(p) - 1))
    turn = F.zip_with(
        F.zip_with(prv, p, lambda o, a: F.struct(o.alias("o"), a.alias("a"))),
        nxt,
        lambda s, b: (s["a"]["x"] - s["o"]["x"]) * (b["y"] - s["o"]["y"])
        - (s["a"]["y"] - s["o"]["y"]) * (b["x"] - s["o"]["x"]),
    )
    convex = let(turn, lambda t: ~(F.exists(t, lambda c: c > 0) & F.exists(t, lambda c: c < 0))) & (F.size(p) >= 3)

    def corner(s, b):
        ux, uy = s["a"]["x"] - s["o"]["x"], s["a"]["y"] - s["o"]["y"]
        vx, vy = s["a"]["x"] - b["x"], s["a"]["y"] - b["y"]
        norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy) + 1e-9
        return F.acos((ux * vx + uy * vy) / norm)

    angles = F.zip_with(F.zip_with(prv, p, lambda o, a: F.struct(o.alias("o"), a.alias("a"))), nxt, corner)

    def angle_ok(a):
        inside = (F.array_min(a) >= 0.15 * PI) & (F.array_max(a) <= 0.85 * PI)
        square = (F.size(a) == 4) & ~info.contains("rectangle") & ~info.contains("square")
        tri = (F.size(a) == 3) & ~info.contains("equilateral triangle")
        near = lambda t: F.forall(a, lambda x: F.abs(x - t) <= 0.3)
        return inside & ~(square & near(PI / 2)) & ~(tri & near(PI / 3))

    steps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), dist)
    apart = F.forall(steps, lambda d: d >= 0.01)
    return let(
        F.struct(convex.alias("convex"), let(angles, angle_ok).alias("angles"), apart.alias("apart")),
        lambda v: F.struct(
            v["convex"].alias("convex"), v["angles"].alias("angles"), v["apart"].alias("apart"),
            (v["convex"] & v["angles"] & v["apart"]).alias("valid"),
        ),
    )


def simple_polygon(points) -> Column:
    """GEO-19: points ordered by angle around their mean, farther first on ties."""
    p = _c(points)

    def order(c):
        tagged = F.transform(
            p, lambda s: F.struct(polar_angle(c, s).alias("a"), (-dist(c, s)).alias("d"), s["x"].alias("x"), s["y"].alias("y"))
        )
        return F.transform(F.array_sort(tagged), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))

    return let(mean_point(p), order)


def ring_length(points) -> Column:
    """Length of the closed ring through the points."""
    p = _c(points)
    return sum_of(F.zip_with(p, rotate(p), dist))


def ellipse_perimeter(a, b, steps: int = 6) -> Column:
    """4·a·E(1 − b²/a²) with the complete elliptic integral by the AGM."""
    m = 1.0 - _c(b) * _c(b) / (_c(a) * _c(a))
    start = F.struct(
        F.lit(1.0).alias("a"), F.sqrt(1.0 - m).alias("g"), (m / 2.0).alias("s"), F.lit(1.0).alias("w")
    )

    def step(v, _i):
        c = (v["a"] - v["g"]) / 2.0
        return F.struct(
            ((v["a"] + v["g"]) / 2.0).alias("a"), F.sqrt(v["a"] * v["g"]).alias("g"), (v["s"] + v["w"] * c * c).alias("s"),
            (v["w"] * 2.0).alias("w"),
        )

    e = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, step, lambda v: (F.lit(1.0) - v["s"]) * F.lit(PI / 2) / v["a"]
    )
    return 4.0 * _c(a) * e


def spiral_perimeter(r0, growth, max_theta, sides: int = 360) -> Column:
    """Closed 360-gon over the last turn of r0 + g·θ."""

    def at(i):
        th = _c(max_theta) - TAU + i * F.lit(TAU / sides)
        r = _c(r0) + _c(growth) * th
        return pt(r * F.cos(th), r * F.sin(th))

    return let(F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), at), ring_length)


def perimeter(s: Column) -> Column:
    """GEO-18: weight of a shape struct."""
    t = s["type"]
    return (
        F.when(t.isin("segment", "polygon"), ring_length(s["points"]))
        .when(t == "spiral", spiral_perimeter(s["initial_radius"], s["growth_rate"], s["max_theta"]))
        .when(t == "ellipse", ellipse_perimeter(s["major_axis"], s["minor_axis"]))
        .when(t.isin("line", "ray"), line_length(s["points"]))
        .otherwise(0.0)
    )


# --- enrichment --------------------------------------------------------------------------


def shape_type(raw, special_info, n_points) -> Column:
    """GEO-1: special_info wins; segment/ray are lines; polygons are named by 3–6 edges."""
    names = F.array(*[F.lit(t) for t in dims.SHAPE_TYPES])
    n = _c(n_points)
    return F.coalesce(
        F.nullif(F.trim(_c(special_info)), F.lit("")),
        F.when(_c(raw).isin("segment", "ray"), "line")
        .when(_c(raw) == "polygon", F.when(n.between(3, 6), F.try_element_at(names, n + 1)))
        .otherwise(_c(raw)),
    )


def _star_ring(s: Column) -> Column:
    return star_points(
        s["center"], s["outer_radius"], s["inner_radius"], s["num_points"], F.coalesce(s["rotation"], F.lit(0.0))
    )


def _spiral_end(s: Column) -> Column:
    """Last angle of spirals only: no other shape is sampled."""
    return F.when(s["type"] == "spiral", s["max_theta"])


def shape_center(s: Column) -> Column:
    t = s["type"]
    poly = let(polygon_centroid(s["points"]), lambda c: pt(c["x"], c["y"]))
    return (
        F.when(t == "polygon", poly)
        .when(t.isin("line", "segment", "ray"), mean_point(s["points"]))
        .when(t == "sector", sector_centroid(s["center"], s["radius"], s["start_angle"], s["end_angle"]))
        .otherwise(pt(s["center"]["x"], s["center"]["y"]))
    )


def shape_box(s: Column) -> Column:
    t = s["type"]
    return (
        F.when(t.isin("polygon", "line", "segment", "ray"), bbox(s["points"]))
        .when(t == "ellipse", ellipse_box(s["center"], s["major_axis"], s["minor_axis"], F.coalesce(s["rotation"], F.lit(0.0))))
        .when(t == "sector", sector_box(s["center"], s["radius"], s["start_angle"], s["end_angle"]))
        .when(t == "star", let(_star_ring(s), bbox))
        .when(t == "spiral", spiral_box(s["center"], s["initial_radius"], s["growth_rate"], s["sin_params"], _spiral_end(s)))
    )


def shape_area(s: Column) -> Column:
    t = s["type"]
    return (
        F.when(t == "polygon", polygon_area(s["points"]))
        .when(t.isin("line", "segment", "ray"), F.lit(0.0))
        .when(t == "ellipse", ellipse_area(s["major_axis"], s["minor_axis"]))
        .when(t == "sector", sector_area(s["radius"], s["start_angle"], s["end_angle"]))
        .when(t == "star", let(_star_ring(s), polygon_area))
        .when(t == "spiral", spiral_area(s["initial_radius"], s["growth_rate"], s["sin_params"], _spiral_end(s)))
    )


def round_struct(col: Column, dtype: T.DataType, dp: int) -> Column:
    """GEO-17: half-even rounding of every float inside a nested value."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.bround(col, dp)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: round_struct(x, dtype.elementType, dp))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda k, v: round_struct(v, dtype.valueType, dp))
    if isinstance(dtype, T.StructType):
        return let(
            col,
            lambda c: F.when(
                c.isNotNull(), F.struct(*[round_struct(c[f.name], f.dataType, dp).alias(f.name) for f in dtype.fields])
            ),
        )
    return col
