"""Scene enrichment and scene-quality filters over shape tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemark.functions import geometry as G
from scenemark.functions.answers import let
from scenemark.session import stored, work_partitions

PT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("min_x", "max_y", "max_x", "min_y")])


def explode_scenes(scenes: DataFrame) -> DataFrame:
    """Scene records to one row per shape: (image_id, shape_idx, shape)."""
    return scenes.select("image_id", F.posexplode("shapes").alias("shape_idx", "shape"))


def explode_relations(scenes: DataFrame) -> DataFrame:
    return scenes.select("image_id", F.posexplode("relations").alias("ord", "r")).select("image_id", "ord", "r.*")


def enrich(shapes: DataFrame, dp: int = 2) -> DataFrame:
    """GEO-20: type, centre, box and area of every shape; (image_id, shape_idx, shape) in."""
    s = F.col("shape")
    return shapes.select(
        "image_id",
        "shape_idx",
        G.shape_type(s["type"], s["special_info"], F.size(s["points"])).alias("type"),
        G.round_struct(G.shape_center(s), PT, dp).alias("center"),
        G.round_struct(G.shape_box(s), BOX, dp).alias("box"),
        F.bround(G.shape_area(s), dp).alias("area"),
        F.bround(s["major_axis"], dp).alias("major_axis"),
        F.bround(s["rotation"], dp).alias("rotation"),
    )


def type_counts(shapes: DataFrame) -> DataFrame:
    """GEO-20: number of shapes per scene and type."""
    return shapes.groupBy("image_id", "type").agg(F.count(F.lit(1)).alias("n"))


# --- pairs inside a scene ---------------------------------------------------------------
# A scene's canvas is cut into cells at several levels, halved from one to the next; level 0 is
# the whole plane.  A box lives at the level whose cells are no smaller than itself, so it lies in
# at most four of them, and is seen from all coarser ones.  A pair meets at the coarser of its two
# levels, in the one cell that holds the lower left corner of its overlap.

PER_CELL = 16


def scene_levels(items: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """(image_id, level): finest level of the scenes with more than ``per_cell`` items, where a cell
    has about that many if they are spread evenly.  From each scene's own count; small scenes
    have no row."""
    n = items.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_cell)
    return n.select("image_id", F.ceil(F.log2(F.col("n") / per_cell) / 2).cast("int").alias("level"))


def _at(v: Column, level: Column) -> Column:
    return F.when(level == 0, F.lit(0).cast("bigint")).otherwise(F.floor(v * F.pow(F.lit(2.0), level)))


def _cells(b: Column, own: Column) -> Column:
    """Cells (level, x, y) of a box at its own and all coarser levels."""

    def at(level):
        rows = F.sequence(_at(b["min_y"], level), _at(b["max_y"], level))
        of = lambda x: F.transform(rows, lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))
        return F.flatten(F.transform(F.sequence(_at(b["min_x"], level), _at(b["max_x"], level)), of))

    return F.flatten(F.transform(F.sequence(F.lit(0), own), at))


def box_cells(items: DataFrame, payload: Column, per_cell: int = PER_CELL) -> DataFrame:
    """(image_id, level, x, y, own, p): the payload, a struct with ``box``, once per cell it is seen
    from; ``own`` is the level of the box.  Boxes without coordinates are in no cell."""

    def placed(p):
        b = p["box"]
        extent = F.greatest(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"])
        fits = F.greatest(F.lit(0), F.coalesce(F.floor(-F.log2(extent)).cast("int"), F.lit(62)))
        own = F.coalesce(F.least("level", fits), F.lit(0))
        return let(own, lambda o: F.transform(_cells(b, o), lambda c: F.struct(c["level"], c["x"], c["y"], o.alias("own"), p.alias("p"))))

    levels = scene_levels(items, per_cell)
    rows = items.join(levels, "image_id", "left").select("image_id", F.explode(let(payload, placed)).alias("c")).select("image_id", "c.*")
    # both sides of the join read this one exchange
    return rows.repartition(work_partitions(items), "image_id", "level", "x", "y")


#: Scenes of at most so many items are compared inside one row.
HELD = 64


def _meet(u: Column, v: Column) -> Column:
    return (F.greatest(u["min_x"], v["min_x"]) <= F.least(u["max_x"], v["max_x"])) & (
        F.greatest(u["min_y"], v["min_y"]) <= F.least(u["max_y"], v["max_y"])
    )


def split_scenes(items: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Items of scenes of at most ``most``, and those of crowded ones, if there are any.

    The ids of crowded scenes are stored, so the planner knows how few they are and the items
    need not be moved to be told apart.  Items without a scene are in neither."""
    n = items.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(n.filter((F.col("n") > most) & F.col("image_id").isNotNull()).select("image_id"), "crowded")
    known = items.filter(F.col("image_id").isNotNull())
    if crowded.isEmpty():
        return known, None
    return known.join(crowded, "image_id", "left_anti"), known.join(crowded, "image_id", "left_semi")


def _held_meetings(items: DataFrame, key: list[str], box: Column, carry: list[str], alone: bool) -> DataFrame:
    """Meetings inside small scenes: items move once, by scene, and stay there; with ``alone`` an
    item that meets no earlier one has a row without ``a``."""
    moved = items.select("image_id", *dict.fromkeys(key + carry)).repartition(work_partitions(items), "image_id")
    scene = moved.groupBy("image_id").agg(F.collect_list(F.struct(*key, box.alias("box"), *[c for c in carry if c != "box"])).alias("all"))
    each = scene.select("image_id", "all", F.explode("all").alias("b"))
    k, b = key[0], F.col("b")
    earlier = F.filter("all", lambda a: (a[k] < b[k]) & _meet(a["box"], b["box"]))
    return each.select("image_id", "b", (F.explode_outer if alone else F.explode)(earlier).alias("a")).select("image_id", "a", "b")


def _cell_meetings(items: DataFrame, key: list[str], box: Column, carry: list[str], per_cell: int) -> DataFrame:
    """Meetings in the cells of crowded scenes."""
    cells = box_cells(items, F.struct(*key, box.alias("box"), *[c for c in carry if c != "box"]), per_cell)
    place = ["image_id", "level", "x", "y"]
    home = cells.filter("own = level").select(*place, "p")
    seen = cells.select(*place, F.col("p").alias("q"), (F.col("own") > F.col("level")).alias("finer"))
    u, v = F.col("p.box"), F.col("q.box")
    meet = (
        _meet(u, v)
        & (_at(F.greatest(u["min_x"], v["min_x"]), F.col("level")) == F.col("x"))
        & (_at(F.greatest(u["min_y"], v["min_y"]), F.col("level")) == F.col("y"))
    )
    earlier = F.col(f"p.{key[0]}") < F.col(f"q.{key[0]}")
    other = F.col(f"p.{key[0]}") > F.col(f"q.{key[0]}")
    met = home.join(seen, place).filter((earlier | (F.col("finer") & other)) & meet)
    return met.select("image_id", F.when(earlier, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(earlier, F.col("q")).otherwise(F.col("p")).alias("b"))


def box_meetings(items: DataFrame, key: list[str], box: Column, carry: list[str], per_cell: int = PER_CELL) -> DataFrame:
    """Pairs (a, b) of one scene whose boxes meet, a before b; columns are structs of ``key``,
    ``box``, made from the other columns once they have moved, and ``carry``.  A small scene is
    compared in its row; a crowded one is cut into cells, so its work is spread, and only
    boxes that really meet leave the join."""
    small, crowded = split_scenes(items, min(per_cell, HELD))
    met = _held_meetings(small, key, box, carry, False)
    return met if crowded is None else met.unionByName(_cell_meetings(crowded, key, box, carry, per_cell))


def _meeting_sums(shapes: DataFrame, box: Column, carry: list[str], value, zero: Column, name: str, per_cell: int) -> DataFrame:
    """(image_id, shape_idx, name): sum of ``value(a, b)`` over the earlier shapes that a shape meets."""
    small, crowded = split_scenes(shapes, min(per_cell, HELD))
    own, a, b = F.col("b.shape_idx").alias("shape_idx"), F.col("a"), F.col("b")
    key = ["image_id", "shape_idx"]
    total = lambda rows: rows.groupBy(*key).agg(F.sum("v").alias(name))
    held = _held_meetings(small, ["shape_idx"], box, carry, True)
    sums = total(held.select("image_id", own, F.coalesce(F.when(a.isNotNull(), value(a, b)), zero).alias("v")))
    rest = shapes.filter(F.col("image_id").isNull())
    none = (rest if crowded is None else rest.unionByName(crowded)).select(*key, zero.alias("v"))
    if crowded is not None:
        met = _cell_meetings(crowded, ["shape_idx"], box, carry, per_cell)
        none = none.unionByName(met.select("image_id", own, F.coalesce(value(a, b), zero).alias("v")))
    return sums.unionByName(total(none))


def overlap_sums(shapes: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """GEO-11: per shape the sum of IoU with the earlier shapes of its scene."""
    return _meeting_sums(shapes, F.col("box"), ["box"], lambda a, b: G.iou(a["box"], b["box"]), F.lit(0.0), "iou_sum", per_cell)


def no_overlap(shapes: DataFrame, threshold: float = 0.2, per_cell: int = PER_CELL) -> DataFrame:
    """GEO-11: shapes whose overlap with the earlier ones stays within the threshold."""
    ok = overlap_sums(shapes, per_cell).filter(F.col("iou_sum") <= threshold)
    return shapes.join(ok.select("image_id", "shape_idx"), ["image_id", "shape_idx"], "left_semi")


def in_canvas(shapes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """GEO-12."""
    return shapes.filter(G.canvas_ratio(F.col("box")) >= threshold)


def count_crossings(p: Column, q: Column) -> Column:
    """Crossings between the edges of two closed rings."""
    ring = lambda r: F.zip_with(r, G.rotate(r), lambda a, b: F.struct(a.alias("s"), b.alias("e")))

    def against(other):
        def one(n, e):
            hit = lambda m, f: m + G.segments_intersect(e["s"], e["e"], f["s"], f["e"]).cast("int")
            return F.aggregate(other, n, hit)

        return F.aggregate(ring(p), F.lit(0), one)

    return let(ring(q), against)


def _ring_crossings(p: np.ndarray, q: np.ndarray, slack: float = 0.1) -> np.ndarray:
    """``count_crossings`` of many pairs of rings, arrays of (pair, point, 2)."""
    x1, y1 = p[:, :, None, 0], p[:, :, None, 1]
    x3, y3 = q[:, None, :, 0], q[:, None, :, 1]
    x2, y2 = np.roll(x1, -1, 1), np.roll(y1, -1, 1)
    x4, y4 = np.roll(x3, -1, 2), np.roll(y3, -1, 2)
    turn = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    first = (x4 - x3) * (y1 - y3) - (y4 - y3) * (x1 - x3)
    second = (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)
    crossed = np.abs(turn) >= 1e-9
    by = np.where(crossed, turn, 1.0)
    inside = lambda at: (at >= -slack) & (at <= 1 + slack)
    hits = crossed & inside(first / by) & inside(-second / by)
    flat = ~crossed & (np.abs(second) < 1e-9)
    if flat.any():

        def meet(s1, s2, s3, s4):
            return np.maximum(np.minimum(s1, s2), np.minimum(s3, s4)) <= np.minimum(np.maximum(s1, s2), np.maximum(s3, s4)) + 1e-12

        along = np.where((x1 == x2) & (y1 == y2), (x1 == x3) & (y1 == y3), meet(x1, x2, x3, x4) & meet(y1, y2, y3, y4))
        hits |= flat & along
    return hits.sum((1, 2))


def crossings(shapes: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """GEO-14: per shape of (image_id, shape_idx, points) the number of edge crossings with
    earlier shapes of its scene.

    An edge lengthened by the 10 % tolerance stays within the shape's box grown by a tenth,
    so only shapes whose grown boxes meet are compared, edge by edge."""

    def grow(v):
        px, py = (v["max_x"] - v["min_x"]) * 0.1 + 1e-6, (v["max_y"] - v["min_y"]) * 0.1 + 1e-6
        return G.box(v["min_x"] - px, v["max_y"] + py, v["max_x"] + px, v["min_y"] - py)

    ring = F.when(F.size("points") >= 2, G.flat_points("points"))
    rings = shapes.select("image_id", "shape_idx", ring.alias("flat")).withColumn("fine", G.ordinary(F.col("flat")))
    box = let(G.bbox(G.points_of(F.col("flat"))), grow)
    count = G.of_pairs(_ring_crossings, count_crossings)
    value = lambda a, b: count(a, b).cast("bigint")
    return _meeting_sums(rings, box, ["flat", "fine"], value, F.lit(0).cast("bigint"), "crossings", per_cell)


def valid_intersection(shapes: DataFrame, most: int = 1, per_cell: int = PER_CELL) -> DataFrame:
    """GEO-14: shapes that add at most ``most`` crossings."""
    ok = crossings(shapes, per_cell).filter(F.col("crossings") <= most)
    return shapes.join(ok.select("image_id", "shape_idx"), ["image_id", "shape_idx"], "left_semi")


# --- point series -----------------------------------------------------------------------


def unique_x(points: DataFrame, key: str = "id") -> DataFrame:
    """GEO-21: one point per x, the first by seq; a single point gets a neighbour on both
    sides.  Map-side combined: ``min`` of (seq, y) per (id, x)."""
    first = points.groupBy(key, "x").agg(F.min(F.struct("seq", "y")).alias("s")).select(key, "x", "s.seq", "s.y")
    lone = (
        first.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("seq").alias("seq"), F.min("y").alias("y"))
        .filter("n = 1")
    )
    pads = lone.select(key, F.explode(F.array(F.col("x") - 1, F.col("x") + 1)).alias("x"), "seq", "y")
    return first.unionByName(pads)


#: Positions of a series that are averaged together.
STRETCH = 1 << 16


def smooth(df: DataFrame, key: str, seq: str, value: str, w: int = 3, name: str = "smoothed", stretch: int = STRETCH) -> DataFrame:
    """GEO-22: centred moving average clipped at the ends; short series stay unchanged.

    ``seq`` is a dense position from 0 or 1 (see ordered_rank).  A series is cut into stretches, and
    the w//2 positions next to a cut are handed over to the stretch beyond it, so one shuffle
    on (key, stretch) does, and no series has to fit one task."""
    half, size = w // 2, max(stretch, 4 * w)
    at = F.floor(F.col(seq) / size)
    off = F.col(seq) - at * size
    parts = F.array(at, F.when((off < half) & (at > 0), at - 1), F.when(off >= size - half, at + 1))
    cut = df.select("*", at.alias("_own"), F.explode(F.array_compact(parts)).alias("_part"))
    part = Window.partitionBy(key, "_part")
    around = part.orderBy(seq).rowsBetween(-half, half)
    short = (F.col("_part") == 0) & (F.count(F.lit(1)).over(part) < w)
    mean = cut.withColumn(name, F.when(short, F.col(value)).otherwise(F.avg(value).over(around)))
    return mean.filter("_own = _part").drop("_own", "_part")


def real_area(areas: DataFrame, catalogue: DataFrame) -> DataFrame:
    """GEO-23: pixel area × scale²; images without a scale are kept with a NULL area."""
    return (
        areas.filter(F.col("pixel_area") > 0)
        .join(catalogue.select("image", "scale"), "image", "left")
        .withColumn("area", F.col("pixel_area") * F.col("scale") * F.col("scale"))
    )
