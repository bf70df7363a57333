"""Post-processing of measured features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scenemark import dims
from scenemark.functions import geometry as G
from scenemark.functions.answers import find_all
from scenemark.functions.classes import range_class_open
from scenemark.functions.numeric import fixed
from scenemark.functions.rnd import _c
from scenemark.operators.sampling import top_k


def valid_images(catalogue: DataFrame, available: DataFrame) -> DataFrame:
    """MEA-1: (species, image, pixel_mm, desc) of axial sections that have a scale and an
    available image.  ``catalogue(species, info struct<desc, images>)``."""
    img = catalogue.select("species", F.col("info.desc").alias("desc"), F.explode("info.images").alias("i"))
    rows = img.select("species", "desc", "i.image", "i.section_type", F.col("i.pixel_mm").alias("pixel_mm"))
    keep = F.lower("section_type").contains("axial") & (F.col("pixel_mm") > 0)
    return rows.filter(keep).join(available.select("image"), "image", "left_semi").drop("section_type")


def to_mm(df: DataFrame) -> DataFrame:
    """MEA-2: length, width, ratio and size class; a zero width gives a NULL ratio."""
    ln, wd = F.col("px_length") * F.col("pixel_mm"), F.col("px_width") * F.col("pixel_mm")
    size = (
        F.when(F.col("length") < 1, "minute")
        .when(F.col("length") < 3, "small")
        .when(F.col("length") < 6, "medium")
        .when(F.col("length") < 10, "large")
        .when(F.col("length") < 20, "mega")
        .otherwise("gigantic")
    )
    return (
        df.withColumn("length", ln)
        .withColumn("width", wd)
        .withColumn("ratio", F.try_divide("length", "width"))
        .withColumn("size", size)
    )


def contour_class(df: DataFrame) -> DataFrame:
    """MEA-3: equator, poles and slopes from angles (radians) and convexity scores."""
    eq = (F.col("upper_angle") + F.col("lower_angle")) / 2
    po = (F.col("left_angle") + F.col("right_angle")) / 2
    sl = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return (
        df.withColumn("equator", F.when(eq < 2.95, "convex").when(eq < 3.15, "straight").otherwise("concave"))
        .withColumn("poles", F.when(po < 2.35, "pointed").otherwise("blunted"))
        .withColumn("slopes", F.when(sl < -2.3, "convex").when(sl < -0.8, "straight").otherwise("concave"))
    )


def shape_class(ratio, slopes) -> Column:
    """MEA-4: shape from ratio and slope; NULL where no range fits."""
    return F.when(_c(slopes) == "convex", range_class_open(ratio, dims.ELLIPSOIDAL_SHAPES)).otherwise(
        range_class_open(ratio, dims.FUSIFORM_SHAPES)
    )


def _sides(whorls: DataFrame) -> DataFrame:
    return whorls.groupBy("image").agg(
        F.countDistinct(F.when(F.col("idx") > 0, F.col("idx"))).alias("pos"),
        F.countDistinct(F.when(F.col("idx") < 0, F.col("idx"))).alias("neg"),
    )


def whorl_count(whorls: DataFrame) -> DataFrame:
    """MEA-5: the larger side if the sides differ by more than one, else their mean."""
    big, small = F.greatest("pos", "neg"), F.least("pos", "neg")
    return _sides(whorls).select(
        "image", F.when(big > small + 1, big.cast("double")).otherwise((F.col("pos") + F.col("neg")) / 2.0).alias("n")
    )


def whorl_count_simple(whorls: DataFrame) -> DataFrame:
    """MEA-5, simple variant: half of all whorls if both sides occur, else all."""
    total = F.col("pos") + F.col("neg")
    return _sides(whorls).select(
        "image", F.when((F.col("pos") > 0) & (F.col("neg") > 0), total / 2.0).otherwise(total.cast("double")).alias("n")
    )


def larger_side(points: DataFrame) -> DataFrame:
    """Points of the side with more whorls where the sides differ by more than one."""
    s = _sides(points)
    j = points.join(s, "image")
    one = F.greatest("pos", "neg") > F.least("pos", "neg") + 1
    keep = ~one | F.when(F.col("pos") > F.col("neg"), F.col("idx") > 0).otherwise(F.col("idx") < 0)
    return j.filter(keep).drop("pos", "neg")


def whorl_heights(points: DataFrame, chamber: DataFrame | None = None) -> DataFrame:
    """MEA-6: per (image, whorl) the distance of the mean y to the next inner whorl, upper
    and lower side averaged.  ``chamber(image, upper_y, lower_y)`` stands in below the
    first whorls."""
    mean = points.groupBy("image", "idx").agg(F.avg("y").alias("y"))
    inner = mean.select("image", F.col("idx").alias("inner"), F.col("y").alias("inner_y"))
    if chamber is not None:
        ends = chamber.select("image", F.explode(F.array(F.struct(F.lit(1).alias("i"), F.col("upper_y").alias("y")), F.struct(F.lit(-1).alias("i"), F.col("lower_y").alias("y")))).alias("e"))
        first = ends.select("image", (F.col("e.i") * 1000000).alias("inner"), F.col("e.y").alias("inner_y"))
        inner = inner.unionByName(first)
    step = F.when(F.abs("idx") == 1, F.col("idx") * 1000000).otherwise(F.col("idx") - F.signum("idx").cast("int"))
    j = mean.withColumn("inner", step).join(inner, ["image", "inner"])
    return j.groupBy("image", F.abs("idx").alias("whorl")).agg(F.avg(F.abs(F.col("y") - F.col("inner_y"))).alias("height"))


def whorl_height_rejects(points: DataFrame, chamber: DataFrame | None = None) -> DataFrame:
    """RES-3 beside whorl_heights: (image, idx) of the whorl sides without an inner neighbour."""
    sides = points.select("image", "idx").distinct()
    inner = sides.select("image", (F.col("idx") + F.signum("idx").cast("int")).alias("idx"))
    if chamber is not None:
        first = chamber.select("image", F.explode(F.array(F.lit(1), F.lit(-1))).alias("idx"))
        inner = inner.unionByName(first)
    return sides.join(inner, ["image", "idx"], "left_anti")


def whorl_thickness(df: DataFrame) -> DataFrame:
    """MEA-7: (image, whorl, thickness, mean_thickness) from relative thickness × height."""
    t = F.col("thickness") * F.col("img_height")
    mean = df.groupBy("image").agg(F.avg(t).alias("mean_thickness"))
    per = df.groupBy("image", F.abs("idx").alias("whorl")).agg(F.avg(t).alias("thickness"))
    return per.join(mean, "image")


def tunnel_angles(sides: DataFrame) -> DataFrame:
    """MEA-8: angle per whorl at the centre between two side points; below 5° dropped,
    upper and lower averaged, truncated."""
    a = G.vertex_angle(F.col("center"), F.col("p1"), F.col("p2"))
    kept = sides.withColumn("a", a).filter(F.col("a") >= 5)
    return kept.groupBy("image", F.abs("idx").alias("whorl")).agg(
        F.floor(F.avg(F.floor("a"))).cast("bigint").alias("angle")
    )


def clean_angles(angles: DataFrame, counts: DataFrame, lo: float = 15, hi: float = 55) -> DataFrame:
    """MEA-9: missing whorls take 25; values outside [lo, hi] the mean of those strictly
    inside; then half the value and half a linear trend from min to max."""
    want = counts.select("image", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("whorl"))
    a = want.join(angles, ["image", "whorl"], "full_outer").withColumn("angle", F.coalesce("angle", F.lit(25)).cast("double"))
    inside = F.when((F.col("angle") > lo) & (F.col("angle") < hi), F.col("angle"))
    mean = a.groupBy("image").agg(F.coalesce(F.floor(F.avg(inside)), F.lit(25)).cast("double").alias("_m"))
    fixed = a.join(mean, "image").withColumn(
        "angle", F.when((F.col("angle") < lo) | (F.col("angle") > hi), F.col("_m")).otherwise(F.col("angle"))
    )
    ends = fixed.groupBy("image").agg(F.min("angle").alias("_lo"), F.max("angle").alias("_hi"), F.max("whorl").alias("_n"))
    trend = F.col("_lo") + (F.col("whorl") - 1) * ((F.col("_hi") - F.col("_lo")) / (F.col("_n") - 1))
    out = F.when((F.col("_hi") > F.col("_lo")) & (F.col("_n") > 1), F.floor(0.5 * F.col("angle") + 0.5 * trend)).otherwise(F.col("angle"))
    return fixed.join(ends, "image").select("image", "whorl", out.cast("bigint").alias("angle"))


def _micron(v, pixel_mm) -> Column:
    return F.floor(v * pixel_mm * 1000).cast("bigint").cast("string")


INTRO = "The following is an image of a paleontological fossil, please provide a detailed description for the fossil image. "


def instruction(df: DataFrame) -> DataFrame:
    """MEA-10: instruction text with the measurements; thicknesses and heights are arrays in
    pixels, optional parts are left out when NULL."""
    px = F.col("pixel_mm")
    many = lambda c: F.array_join(F.transform(c, lambda v: _micron(v, px)), ", ")
    lines = F.concat(
        F.lit(INTRO + "Here is some information about the fossil that must be included in the description:\n"),
        F.concat(F.lit("size: "), "size", F.lit(", shape: "), "shape", F.lit(", equator(central part): "), "equator", F.lit(", slopes: "), "slopes", F.lit(", poles: "), "poles", F.lit("\n")),
        F.concat(F.lit("length: "), fixed("length", 3), F.lit(" mm. , width(diameter): "), fixed("width", 3), F.lit(" mm. ratio: "), fixed("ratio", 3), F.lit("\n")),
        F.concat(F.lit("number of volutions(whorls): "), F.col("num_volutions").cast("string"), F.lit("\n")),
        F.concat(F.lit("average thickness of spirotheca: "), _micron(F.col("avg_thickness"), px), F.lit(" microns\n")),
        F.concat(F.lit("thickness by volutions: "), many("thickness"), F.lit(" microns\n")),
        F.concat(F.lit("heights of volution/whorl: "), many("heights"), F.lit(" microns\n")),
        F.coalesce(F.concat(F.lit("initial chamber(proloculus): "), F.floor("chamber").cast("string"), F.lit(" microns\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("tunnel angle: "), F.col("tunnel_angle").cast("string"), F.lit(" degrees.\n")), F.lit("")),
    )
    return df.withColumn("instruction", lines)


def plain_instruction(df: DataFrame) -> DataFrame:
    """MEA-10 without measurements: only the resolution and size of the image."""
    text = F.concat(
        F.lit(INTRO + "The resolution of the fossil image is "), F.col("img_width").cast("string"), F.lit("×"), F.col("img_height").cast("string"),
        F.lit(", and the width and height of the image are "), fixed(F.col("img_width") * F.col("pixel_mm"), 3), F.lit(" mm and "),
        fixed(F.col("img_height") * F.col("pixel_mm"), 3), F.lit(" mm, respectively."),
    )
    return df.withColumn("instruction", text)


def feature_strings(df: DataFrame) -> DataFrame:
    """MEA-11: measurements as feature texts with units, '' when absent."""
    px = F.col("pixel_mm")
    blank = lambda c: F.coalesce(c, F.lit(""))
    many = lambda c: F.concat(F.array_join(F.transform(c, lambda v: _micron(v, px)), ", "), F.lit(" microns"))
    return df.select(
        F.col("image").alias("image_path"),
        blank(F.when(F.col("length").isNotNull(), F.concat(fixed("length", 3), F.lit(" mm")))).alias("length"),
        blank(F.when(F.col("width").isNotNull(), F.concat(fixed("width", 3), F.lit(" mm")))).alias("width"),
        blank(F.when(F.col("ratio").isNotNull(), fixed("ratio", 3))).alias("ratio"),
        blank(F.col("num_volutions").cast("string")).alias("number_of_volutions"),
        blank(many("thickness")).alias("thickness_of_spirotheca"),
        blank(many("heights")).alias("height_of_volution"),
        blank(F.concat(F.floor("chamber").cast("string"), F.lit(" microns"))).alias("proloculus"),
        blank(F.concat(F.array_join(F.transform("angles", lambda a: a.cast("string")), ", "), F.lit(" degrees"))).alias("tunnel_angles"),
    )


def size_table(images: DataFrame, catalogue: DataFrame) -> DataFrame:
    """MEA-12: image size in mm; images without a scale are dropped."""
    j = images.join(catalogue.select("image", "scale"), "image").filter(F.col("scale") != 0)
    return j.select(
        F.col("image").alias("image_path"), (F.col("px_width") * F.col("scale")).alias("length"), (F.col("px_height") * F.col("scale")).alias("width")
    )


# --- labels in texts against measured values -------------------------------------------------


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def equator_label(text) -> Column:
    """MEA-13: NULL for ambiguous texts."""
    c = _c(text)
    hollow, full = _any(c, ["concave", "depress"]), _any(c, ["convex", "inflated", "stout", "bulg"])
    return F.when(hollow & full, None).when(hollow, "concave").when(full, "convex").otherwise("straight")


def slope_label(text) -> Column:
    c = _c(text)
    hollow, full = _any(c, ["concave", "depress"]), c.contains("convex")
    return F.when(hollow & full, None).when(hollow, "concave").when(full, "convex").otherwise("straight")


def size_label(text) -> Column:
    c = _c(text)
    return F.when(c.contains("small"), "small").when(c.contains("large"), "large").when(_any(c, ["medium", "moderate"]), "medium")


def poles_labels(text) -> Column:
    """MEA-13: labels of the poles; one per matching adverb, so a text may give several."""
    c = _c(text)
    advs = find_all(c, r"(?U)\b\w+ly\b", 0)
    named = F.filter(
        F.transform(
            advs,
            lambda a: F.when(a.isin("bluntly", "roundly", "obtusely"), "blunted").when(a.isin("sharply", "narrowly"), "pointed"),
        ),
        lambda x: x.isNotNull(),
    )
    plain = (
        F.when(_any(c, ["blunt", "round"]), "blunted")
        .when(_any(c, ["point", "sharp", "taper"]), "pointed")
        .when(_any(c, ["elongate", "extended"]), "elongated")
    )
    unclear = (c.contains("round") & c.contains("point")) | (c.contains("blunt") & c.contains("sharp"))
    alone = F.filter(F.array(plain), lambda x: x.isNotNull())
    return F.when(unclear, F.array().cast("array<string>")).when(F.size(named) > 0, named).otherwise(alone)


def label_vs_value(labels: DataFrame, values: DataFrame, kind: str, key: str = "image_path") -> DataFrame:
    """MEA-13: (key, label, x) with x the measured value; kinds equator, poles, slopes, size."""
    j = values.join(labels, key)
    if kind == "equator":
        out = j.select(key, equator_label("text").alias("label"), ((F.col("upper_angle") + F.col("lower_angle")) / 2).alias("x"))
    elif kind == "poles":
        out = j.select(key, F.explode(poles_labels("text")).alias("label"), ((F.col("left_angle") + F.col("right_angle")) / 2).alias("x"))
    elif kind == "slopes":
        out = j.select(key, slope_label("text").alias("label"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("x")).filter(F.abs("x") <= 10)
    elif kind == "size":
        out = j.select(key, size_label("text").alias("label"), F.col("length").alias("x"))
    else:
        raise ValueError(f"unknown kind: {kind}")
    return out.filter(F.col("label").isNotNull())


def histogram(df: DataFrame, label: str, x: str, bins: int = 19) -> DataFrame:
    """MEA-14: counts per label and bin over shared edges; the last bin is closed."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("_lo")) / width))).otherwise(0)
    return df.crossJoin(F.broadcast(ends)).groupBy(F.col(label).alias("label"), b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Labels whose sums a task holds before it passes them on.
LABELS = 1000


def _shares(grid: int, kind: pa.DataType):
    """Rows (label, x, h, lo, step) -> (label, g, k): kernel sums at every grid point, per task."""

    def out(sums: dict):
        names = [n for n in sums for _ in range(grid)]
        points = np.tile(np.arange(grid, dtype=np.int32), len(sums))
        values = np.concatenate(list(sums.values())) if sums else np.empty(0)
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(points), pa.array(values)], names=["label", "g", "k"])

    def run(batches):
        sums: dict = {}
        for batch in batches:
            label = batch.column("label").dictionary_encode()
            names = label.dictionary.to_pylist() + [None]
            of = np.asarray(label.indices.fill_null(len(names) - 1))
            x, h, lo, step = (np.asarray(batch.column(c)) for c in ("x", "h", "lo", "step"))
            made = np.empty((grid, len(names)))
            for g in range(grid):
                z = (lo + g * step - x) / h
                made[g] = np.bincount(of, np.exp(-0.5 * z * z), len(names))
            for i in np.unique(of):
                sums[names[i]] = sums.get(names[i], 0.0) + made[:, i]
            if len(sums) > LABELS:
                yield out(sums)
                sums = {}
        yield out(sums)

    return run


def kde(df: DataFrame, label: str, x: str, grid: int = 200) -> DataFrame:
    """MEA-15: Gaussian density per label on a shared grid, Scott bandwidth, scaled by the
    label's share.  Rows are added up at all grid points where they are read; a task sends on a
    row per label and grid point, whatever it has read."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_all"))
    per = df.groupBy(F.col(label).alias("label")).agg(F.stddev_samp(x).alias("_s"), F.count(x).alias("_n"))
    per = per.withColumn("h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).filter(F.col("h") > 0).select("label", "h")
    step = (F.col("_hi") - F.col("_lo")) / (grid - 1)
    rows = df.filter(F.col(x).isNotNull()).select(F.col(label).alias("label"), F.col(x).cast("double").alias("x")).join(per, "label").crossJoin(F.broadcast(ends))
    given = rows.select("label", "x", "h", F.col("_lo").cast("double").alias("lo"), step.cast("double").alias("step"))
    sums = given.mapInArrow(_shares(grid, to_arrow_type(given.schema["label"].dataType)), f"label {dict(given.dtypes)['label']}, g int, k double")
    total = sums.groupBy("label", "g").agg(F.sum("k").alias("_k")).join(per, "label").crossJoin(F.broadcast(ends))
    density = F.col("_k") / (F.col("h") * F.sqrt(F.lit(2 * G.PI)) * F.col("_all"))
    return total.select("label", "g", (F.col("_lo") + F.col("g") * step).alias("at"), density.alias("density"))


def extremes(df: DataFrame, label: str, x: str, key: str, k: int = 5) -> DataFrame:
    """MEA-16: the ``k`` smallest and largest rows per label, limited before the shuffle."""
    low = top_k(df, [label], [F.col(x), F.col(key)], k).withColumn("end", F.lit("min"))
    high = top_k(df, [label], [F.col(x).desc(), F.col(key).desc()], k).withColumn("end", F.lit("max"))
    return low.unionByName(high)
