"""Line deduplication on sorted runs of line hashes, in DataFrame functions only.

Lines become (128-bit hash, document, position), range-partitioned on all three and sorted by hash,
then document from the largest down, then position.  The ranges are cut inside a common line too,
so one line in a third of all documents is many runs.  In such a run the first occurrence of a
line is in the document that keeps it, and documents are counted as they go by.  Lines that go
over the end of a run (one per run at most) are counted once more by aggregation.  What comes
out is a compressed bitmap per document: 64-line words, whole words that stay left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemark.llm.exact import normal
from scenemark.session import stored, work_partitions

#: Characters taken off both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3
_HASH = ["h1", "h2"]
_DOC = ["key", "t1", "t2"]


def _hashes(text: str, names: list[str]) -> list[Column]:
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def _named(docs: DataFrame, key: str) -> DataFrame:
    """(text, key, t1, t2): a document is its key and the hash of its text, so equal rows have
    equal bitmaps and nothing depends on the order in which rows are read."""
    given = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col(key).alias("key"))
    return given.select("text", "key", *_hashes("text", ["t1", "t2"]))


def occurrences(docs: DataFrame, key: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, key, t1, t2, pos) of every line whose stripped text has enough characters."""
    lines = _named(docs, key).select(*_DOC, F.posexplode(F.split(normal(F.col("text")), "\n", -1)).alias("pos", "line"))
    long = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).filter(F.length("line") >= least_chars)
    return long.select(*_hashes("line", _HASH), *_DOC, "pos")


def sorted_runs(found: DataFrame) -> DataFrame:
    """The occurrences in order, as a stored table with the run each lies in."""
    order = [*_HASH, F.col("key").desc(), "pos"]
    placed = found.repartitionByRange(work_partitions(found), *order).sortWithinPartitions(*order)
    return stored(placed.withColumn("run", F.spark_partition_id()), "runs")


def _over_ends(runs: DataFrame) -> DataFrame:
    """(h1, h2, all_docs, last) of lines in several runs; fewer rows than runs."""
    line = F.struct(*_HASH)
    ends = runs.groupBy("run").agg(F.array(F.min(line), F.max(line)).alias("ends")).select("run", F.explode("ends").alias("line"))
    split = ends.groupBy("line.h1", "line.h2").agg(F.count_distinct("run").alias("runs")).filter("runs > 1").drop("runs")
    return runs.join(F.broadcast(split), _HASH).groupBy(*_HASH).agg(F.count_distinct(F.struct("key")).alias("all_docs"), F.max(F.struct("key")).alias("last"))


def dropped(runs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(key, t1, t2, pos) of lines found in enough documents, but in the one of largest key."""
    line = Window.partitionBy("run", *_HASH)
    down = line.orderBy(F.col("key").desc(), "pos")
    new = (F.row_number().over(down) == 1) | ~F.col("key").eqNullSafe(F.lag("key").over(down))
    inside = runs.withColumn("new", new.cast("int")).withColumn("top", F.first(F.struct("key")).over(down)).withColumn("docs", F.sum("new").over(line))
    whole = inside.join(F.broadcast(_over_ends(runs)), _HASH, "left")
    last = F.coalesce("last", "top")["key"]
    return whole.filter((F.coalesce("all_docs", "docs") >= least_docs) & ~F.col("key").eqNullSafe(last)).select(*_DOC, "pos")


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(key, t1, t2, gone): for each document that loses lines, the words of its bitmap with a
    line that goes, ascending, as (word, bits); lines of other words and bits not set stay."""
    gone = dropped(sorted_runs(occurrences(docs, key, least_chars)), least_docs)
    bits = F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    words = gone.groupBy(*_DOC, F.shiftright("pos", 6).alias("word")).agg(bits)
    return stored(words.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("gone")), "bitmaps")


def _stays(lines: Column, gone: Column) -> Column:
    """Lines whose bit is not set.  The bitmap is filled up with zero words first, so that a
    line finds its word by place."""
    before = lambda i: F.coalesce(F.get(gone, i - 1)["word"], F.lit(-1))
    full = F.flatten(F.transform(gone, lambda w, i: F.concat(F.array_repeat(F.lit(0).cast("bigint"), w["word"] - before(i) - 1), F.array(w["bits"]))))
    bit = lambda i: F.call_function("bit_get", F.coalesce(F.get(F.col("_full"), F.shiftright(i, 6)), F.lit(0).cast("bigint")), i.bitwiseAND(F.lit(63)))
    return full, F.filter(lines, lambda _, i: bit(i) == 0)


def deduplicated(docs: DataFrame, key: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(``key``, n_lines, n_dropped, kept): every row's text without the lines that go.

    A text is cut at line feeds (NULL or empty: one empty line).  Lines are equal when the same
    after stripping and lower-casing A-Z.  A line of ``least_chars`` characters that
    ``least_docs`` keys hold stays in the document of largest key only, there wherever it stands.
    Rows of one key are one document; a NULL key is a document smaller than all others; repeated
    rows come out as often.  Other columns are not read; an empty table gives no rows."""
    maps = keep_bitmaps(docs, key, least_chars, least_docs).toDF("_key", "_t1", "_t2", "gone")
    given = _named(docs, key)
    # bitmaps grow with the input: always a shuffle of both sides
    same = given["key"].eqNullSafe(maps["_key"]) & (given["t1"] == maps["_t1"]) & (given["t2"] == maps["_t2"])
    rows = given.join(maps.hint("merge"), same, "left").withColumn("lines", F.split("text", "\n", -1))
    full, stays = _stays(F.col("lines"), F.col("gone"))
    n = F.aggregate("gone", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["bits"]))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    return rows.withColumn("_full", full).select(
        F.col("key").alias(key), F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept")
    )


def digests(docs: DataFrame, key: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``deduplicated`` with the SHA-256 of the text that stays in its place."""
    return deduplicated(docs, key, least_chars, least_docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
