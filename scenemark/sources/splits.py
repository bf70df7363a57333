"""Places of lines and of JSON records in files that many tasks read.

A scan says in which split of which file a row lies, and a task reads the rows of a split in
order; sums over splits, of which there are few, give every row its place in the whole file
without sorting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenemark.session import stored

SPLIT = ["file", "split"]


def placed_lines(spark: SparkSession, paths: str | list[str], sep: str = "\n") -> DataFrame:
    """(value, file, size, split, mid): lines with their file's bytes and the start of their split,
    ``mid`` ascending within it.  Written once, so that places and lines come from one reading."""
    lines = spark.read.option("lineSep", sep).text(paths)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split")]
    return stored(lines.select("value", *where, F.monotonically_increasing_id().alias("mid")), "lines")


def before_splits(rows: DataFrame, amount: Column, order: list[str] | None = None) -> DataFrame:
    """(file, split, before) and the columns of ``order``: the sum of ``amount`` over the splits
    before each one, within its file or, with ``order``, over all files in that order."""
    keys = list(dict.fromkeys([*(order or []), *SPLIT]))
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("n"))
    # one row a split: the window's input is as small as the list of splits
    within = Window.partitionBy(F.lit(0)).orderBy(*order, "split") if order else Window.partitionBy("file").orderBy("split")
    prefix = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, prefix.alias("before"))


def _running(amount: Column) -> Column:
    """Sum up to and with the row, within its split."""
    return F.sum(amount).over(Window.partitionBy(*SPLIT).orderBy("mid").rowsBetween(Window.unboundedPreceding, 0))


def _braces(bare: Column, first: int) -> Column:
    """Opening braces in every other part between quotes, from part ``first`` on."""
    parts = F.filter(F.split(bare, '"', -1), lambda _, i: i % 2 == first)
    text = F.array_join(parts, "")
    return F.length(text) - F.length(F.replace(text, F.lit("{")))


def json_records(spark: SparkSession, paths: str | list[str], keyed: bool) -> DataFrame:
    """(file, record, text, whole): the objects of JSON arrays, or with ``keyed`` the entries of JSON
    maps of objects, in order, each as its own text; ``whole`` is false for what a broken file ends in.

    Files are read in pieces that end with a closing brace, so a file of one line is cut into
    splits too.  Whether a piece starts inside a string follows from the number of quotes
    before it, and how deep it ends from the braces outside strings: both are sums, within
    the split and over the splits before.  A record ends where the depth is back."""
    pieces = placed_lines(spark, paths, "}")
    # whether a file's last piece has its brace: bytes tell (or three more, of a byte order mark)
    rest = F.max("size") - F.sum(F.octet_length("value") + 1)
    files = pieces.groupBy("file").agg(F.max(F.struct("split", "mid")).alias("end"), rest.isin(0, 3).alias("closed"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # an escape never spans a closing brace
    seen = pieces.withColumn("bare", bare).withColumn("quotes", F.length("bare") - F.length(F.replace("bare", F.lit('"'))))
    inside = F.col("before") + _running(F.col("quotes"))
    known = seen.join(before_splits(seen, F.col("quotes")), SPLIT).withColumn("after", inside % 2).withColumn("within", (inside - F.col("quotes")) % 2)
    opens = F.when(F.col("within") == 0, _braces(F.col("bare"), 0)).otherwise(_braces(F.col("bare"), 1))
    broken = (F.struct("split", "mid") == F.col("end")) & ~F.col("closed")
    closes = ((F.col("after") == 0) & ~broken).cast("int")
    level = known.join(files, "file").withColumn("closes", closes).withColumn("step", opens - F.col("closes"))
    level = stored(level.select("value", "file", "split", "mid", "closes", "step"), "levels")
    deep = level.join(before_splits(level, F.col("step")), SPLIT).withColumn("depth", F.col("before") + _running(F.col("step"))).drop("before")
    ended = deep.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") == int(keyed))).cast("int"))
    ended = stored(ended.drop("closes", "step", "depth"), "ends")
    record = F.col("before") + _running(F.col("ends")) - F.col("ends")
    numbered = ended.join(before_splits(ended, F.col("ends")), SPLIT).withColumn("record", record)
    whole = numbered.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("split", "mid", "value"))).alias("pieces"), (F.max("ends") == 1).alias("whole")
    )
    # the pieces of one record belong together; closing braces come back between them
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.when(F.col("whole"), "}").otherwise(""))
    head = r"^[\s,\[{]+" if keyed else r"^[\s,\[]+"
    clean = whole.select("file", "record", F.regexp_replace(text, head, "").alias("text"), "whole")
    return clean.filter(F.col("whole") | ~F.col("text").rlike(r"^[\s\]}]*$"))
