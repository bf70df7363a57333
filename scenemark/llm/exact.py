"""Exact deduplication against immutable snapshots with binary fuse filters.

A snapshot keeps its distinct digests in exact buckets and one static filter per bucket.  An
incoming batch is grouped by digest (its own duplicates meet there); only digests that a
bucket's filter lets through are joined with the exact bucket.  Every group of more than one
row is then compared byte by byte, by aggregation on the text itself, so copies collapse in
the map tasks and a group of any size costs a row per task.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemark.llm import fuse
from scenemark.session import stored

#: Digests that one filter holds; buckets are as many as the larger side needs.
BUCKET_KEYS = 200_000
FULL = 64


def normal(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; NULL counts as empty."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def digested(docs: DataFrame, key: str = "doc_id", digits: int = FULL) -> DataFrame:
    """(row, key, sha, digest) per row; ``digest`` is the first ``digits`` of ``sha``."""
    sha = F.sha2(normal(F.col("text")), 256)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), sha.alias("sha")).withColumn("digest", F.substring("sha", 1, digits))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, best, n): the row of largest key and the number of rows of each digest."""
    return rows.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("best"), F.count(F.lit(1)).alias("n"))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    seed, length, table = fuse.build(rows["k"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "seed": [seed], "length": [length], "slots": [table.tobytes()]})


def _screen(filters: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    if not len(filters):
        hit = np.zeros(len(batch), bool)
    else:
        f = filters.iloc[0]
        hit = fuse.maybe(batch["k"].to_numpy(np.int64).view(np.uint64), f["seed"], f["length"], np.frombuffer(f["slots"], np.uint8))
    return pd.DataFrame({"digest": batch["digest"], "maybe": hit})


class Snapshot:
    """Exact buckets and filters of one batch of digest groups; never changed once made."""

    def __init__(self, groups: DataFrame, buckets: int):
        self.buckets = buckets
        self.exact = stored(groups.withColumn("bucket", _bucket(buckets)), "exact")
        keys = self.exact.select("bucket", F.xxhash64("digest", F.lit("fuse")).alias("k"))
        self.filters = stored(keys.groupBy("bucket").applyInPandas(_build, "bucket int, seed long, length long, slots binary"), "filters")

    def screen(self, groups: DataFrame) -> DataFrame:
        """(digest, maybe) for every digest of a batch; False only where the snapshot lacks it."""
        batch = groups.select("digest", _bucket(self.buckets).alias("bucket"), F.xxhash64("digest", F.lit("fuse")).alias("k"))
        return self.filters.groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInPandas(_screen, "digest string, maybe boolean")


def screened(old: DataFrame, new: DataFrame) -> DataFrame:
    """(digest, best, n) over a snapshot's rows and an incoming batch's rows together."""
    before, batch = stored(grouped(old), "before"), stored(grouped(new), "batch")
    snapshot = Snapshot(before, max(1, -(-max(before.count(), batch.count()) // BUCKET_KEYS)))
    told = stored(batch.join(snapshot.screen(batch), "digest"), "told")
    exact = snapshot.exact.select("digest", F.col("best").alias("old"), F.col("n").alias("n_old"))
    passed = stored(told.filter("maybe").join(exact, "digest", "left").drop("maybe"), "passed")
    fresh = told.filter("NOT maybe").select("digest", "best", "n")
    false_hit = passed.filter("n_old IS NULL").select("digest", "best", "n")
    hit = passed.filter("n_old IS NOT NULL").select("digest", F.col("best").alias("new"), F.col("n").alias("n_new"))
    both = snapshot.exact.join(hit, "digest", "left").select(
        "digest", F.greatest("best", "new").alias("best"), (F.col("n") + F.coalesce("n_new", F.lit(0))).alias("n")
    )
    return both.unionByName(fresh).unionByName(false_hit)


def _on_rows(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Texts joined with (key, digest) rows.  Always a shuffle of both sides: the row table grows
    with the input, so it is never broadcast."""
    named = rows.select(F.col("key").alias("_key"), F.col("digest").alias("_digest")).hint("merge")
    return texts.join(named, texts["key"].eqNullSafe(named["_key"]) & (texts["digest"] == named["_digest"]), how)


class Resolved:
    """Rows of ``docs`` and the groups of equal texts they fall into.

    ``rows``: (row, key, sha, digest).  ``even``: (digest, best, n) of digests that stand for
    one text each, checked by bytes.  ``odd``: (digest, words, best, n) per text of digests
    that stand for several; ``has_odd`` says whether there are any."""

    def __init__(self, docs: DataFrame, key: str, digits: int):
        self.digits = digits
        self.rows = rows = stored(digested(docs, key, digits), "rows")
        late = F.pmod(F.xxhash64("key"), F.lit(2)) == 1  # the rows that come as a new batch
        groups = stored(screened(rows.filter(~late), rows.filter(late)), "groups")
        # by key, which no group of copies makes hot; copies then collapse before the next shuffle
        several = stored(rows.join(groups.filter("n > 1"), "digest").select("key", "digest"), "several")
        texts = _on_rows(self.texts(docs, key), several, "left_semi")
        exact = texts.groupBy("digest", "words").agg(F.max(F.struct("key")).alias("top"), F.count(F.lit(1)).alias("m"))
        kinds = stored(exact.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "odd")
        self.has_odd = kinds.head(1) != []
        self.even, self.odd = groups, None
        if self.has_odd:
            self.even = groups.join(kinds, "digest", "left_anti")
            self.odd = stored(exact.join(kinds, "digest", "left_semi").select("digest", "words", F.col("top.key").alias("keep"), F.col("m").alias("n")), "odd_texts")

    def texts(self, docs: DataFrame, key: str) -> DataFrame:
        words = normal(F.col("text"))
        return docs.select(F.col(key).alias("key"), words.alias("words")).withColumn("digest", F.substring(F.sha2("words", 256), 1, self.digits))


def duplicates(docs: DataFrame, key: str = "doc_id", digits: int = FULL) -> DataFrame:
    """One row per document: ``key``, ``keep_id`` (largest ``key`` among equal texts),
    ``group_size``, ``kept``, ``text_sha256`` of the normalised text.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty.  Of repeated
    rows (same key and text) one is kept; a NULL key is smaller than any other.  Other columns
    are not read; an empty table gives no rows.  ``digits`` shortens the digest (for tests):
    texts that share a digest but differ are told apart by the byte check; there repeated
    rows are kept together."""
    found = Resolved(docs, key, digits)
    same = found.rows.join(found.even, "digest").select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    if not found.has_odd:
        return same
    apart = found.texts(docs, key).join(found.odd, ["digest", "words"]).select(
        F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("key").eqNullSafe(F.col("keep")).alias("kept"), F.sha2("words", 256).alias("text_sha256"),
    )
    return same.unionByName(apart)


def keep_last(docs: DataFrame, key: str = "doc_id", digits: int = FULL) -> DataFrame:
    """``docs`` with one row of every group of equal texts, that of largest ``key``; columns as
    given, with the rules of ``duplicates`` (repeated rows count as one)."""
    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]
    words = normal(F.col(f"c{names.index('text')}"))
    found = Resolved(docs, key, digits)
    rows = found.rows.join(found.even.filter("n > 1"), "digest").select("key", "digest", F.col("best.key").eqNullSafe(F.col("key")).alias("stays"))
    rows = stored(rows, "copies")
    marked = docs.toDF(*columns).withColumn("key", F.col(f"c{names.index(key)}")).withColumn("digest", F.substring(F.sha2(words, 256), 1, digits))
    out = _on_rows(marked, rows.filter("NOT stays"), "left_anti")
    again = stored(rows.filter("stays").groupBy("key", "digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "again")
    if again.head(1):  # one key repeated with the same text: one of its rows stays
        one = _on_rows(out, again, "left_semi").groupBy("key", "digest").agg(F.min(F.struct(*columns)).alias("s")).select("s.*")
        out = _on_rows(out, again, "left_anti").select(*columns).unionByName(one)
    if found.has_odd:
        odd = found.odd.withColumnRenamed("digest", "_d")
        fits = (F.col("digest") == odd["_d"]) & (words == odd["words"])
        ready = out if "digest" in out.columns else out.withColumn("key", F.col(f"c{names.index(key)}")).withColumn("digest", F.substring(F.sha2(words, 256), 1, digits))
        out = ready.join(odd, fits, "left").filter(F.col("_d").isNull() | F.col("key").eqNullSafe(F.col("keep")))
    return out.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
