"""Importance resampling towards a target, ranked by parallel sorting by regular sampling.

Hashed features of raw and target texts are counted per bucket; a bucket's gain is the logarithm of
its odds, and a document's weight the mean gain of its features, looked up in an array.  Each score
adds Gumbel noise drawn from the document's key, so the highest scores are a draw without
replacement.  Ranks come from sorted runs: samples at regular places give splitters, rows between
two splitters meet in one segment and are merged there, and the segments' sizes before it give
every row its exact place."""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenemark.llm.segments import Cache
from scenemark.session import stored, work_partitions

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Regular samples per segment; the splitters' table has this many rows a segment, and one a run.
SAMPLES = 32
#: Bytes of a text that are cut into words at a time.
WINDOW = 1 << 20

#: Bytes of words are 0-9, a-z (A-Z count as these) and all beyond ASCII.
_WORD = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
TABLE = bytes(b if b in _WORD else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))


def windows(raw: bytes, size: int = WINDOW):
    """``raw``, with word bytes only and spaces, in pieces cut at spaces."""
    at, text = 0, raw.translate(TABLE)
    while len(text) - at > size:
        cut = text.rfind(b" ", at + 1, at + size)
        if cut < 0 and (cut := text.find(b" ", at + size)) < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def ngram_buckets(raw: bytes, bucket: Cache, longest: int) -> tuple[int, np.ndarray]:
    """Number of words, and buckets of all runs of 1 to ``longest`` consecutive words."""
    if longest == 1:
        found = np.concatenate([np.fromiter(map(bucket.__getitem__, w), np.uint32, len(w)) for w in map(bytes.split, windows(raw))])
        return len(found), found
    words = raw.translate(TABLE).split()
    grams = [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), np.fromiter(map(bucket.__getitem__, grams), np.uint32, len(grams))


def _type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _featured(buckets: int, longest: int):
    def run(batches):
        bucket = Cache(lambda w: zlib.crc32(w) % buckets, 200_000)
        for batch in batches:
            made = [ngram_buckets(raw or b"", bucket, longest) for raw in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([len(found) for _, found in made], pa.int64()),
                    pa.array([words for words, _ in made], pa.int64()),
                    pa.array([found.astype(_type(buckets)).tobytes() for _, found in made], pa.binary()),
                ],
                names=["key", "n_features", "n_words", "found"],
            )

    return run


def featured(docs: DataFrame, key: str | None, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(key, n_features, n_words, found): the buckets of every feature of each whole text."""
    name = F.col(key) if key else F.lit(None).cast("bigint")
    given = docs.select(F.col("text").cast("binary").alias("text"), name.alias("key"))
    kind = dict(given.dtypes)["key"]
    return given.mapInArrow(_featured(buckets, longest), f"key {kind}, n_features bigint, n_words bigint, found binary")


def _tally(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(found, _type(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    return run


def tally(features: DataFrame, buckets: int) -> list[int]:
    """Features per bucket; tasks add up first, and ``buckets`` rows reach the driver."""
    sums = features.select("found").mapInArrow(_tally(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = [0] * buckets
    for row in sums.collect():
        total[row.bucket] = row.n
    return total


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Floored 1000 ln of each bucket's odds, target against raw, with one added everywhere."""
    s_all, t_all, n = sum(raw), sum(target), len(raw)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(raw, target)]


def _weighed(gain: list[int]):
    def run(batches):
        table = np.array(gain, np.int64)
        for batch in batches:
            key, n, words, found, h = (batch.column(c) for c in ("key", "n_features", "n_words", "found", "h"))
            weight = [int(table[np.frombuffer(f, _type(len(gain)))].sum()) // k if k else 0 for f, k in zip(found.to_pylist(), n.to_pylist())]
            noise = [math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h.to_pylist()]
            score = [a + b for a, b in zip(weight, noise)]
            yield pa.RecordBatch.from_arrays([key, n, words, pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["key", "n_features", "n_words", "weight", "score"])

    return run


def weighed(features: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(key, n_features, n_words, weight, score) of every document."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    kind = dict(features.dtypes)["key"]
    return features.withColumn("h", h).mapInArrow(_weighed(gain), f"key {kind}, n_features bigint, n_words bigint, weight bigint, score bigint")


# --- ranks --------------------------------------------------------------------------------


def _place(score, key):
    """Sorts like the rows: highest score first, then keys upwards, NULL last."""
    return (-score, key is None, 0 if key is None else key)


def _dealt(splitters: list[tuple]):
    def run(batches):
        for batch in batches:
            at = [bisect.bisect_right(splitters, _place(s, k)) for s, k in zip(batch.column("score").to_pylist(), batch.column("key").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "segment"])

    return run


def ranked(rows: DataFrame, segments: int | None = None) -> tuple[DataFrame, int]:
    """Rows with (key, score) and ``rank``, 1 for the highest score, ties to the smaller key;
    and the number of rows."""
    p = segments or work_partitions(rows)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    runs = stored(rows.sortWithinPartitions(*order).withColumn("_at", place), "runs")
    n = runs.count()
    step = max(1, n // (p * SAMPLES))
    sample = sorted(_place(r.score, r.key) for r in runs.filter(F.col("_at") % step == 0).select("score", "key").collect())
    splitters = [sample[i * len(sample) // p] for i in range(1, p)] if sample else []
    given = runs.drop("_at")
    dealt = stored(given.mapInArrow(_dealt(splitters), f"{', '.join(f'{c} {t}' for c, t in given.dtypes)}, segment int"), "segments")
    merged = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("segment").orderBy(*order)))
    sizes = dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("_n"))  # one row a segment
    before = Window.partitionBy(F.lit(0)).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return merged.join(F.broadcast(offsets), "segment").withColumn("rank", (F.col("_rn") + F.col("_off")).cast("bigint")).drop("segment", "_rn", "_off"), n


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, segments: int | None = None,
) -> DataFrame:
    """(``key``, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is NULL where not drawn.

    Features are runs of 1 to ``longest`` words of the whole lower-cased text (NULL: none), hashed
    to ``buckets``; counts cover all rows of ``docs`` and of ``target``.  Of rows with
    ``least_words`` words, the ``percent`` of highest score are drawn, ties to the smaller key.
    A NULL key draws its noise from the empty text and comes last among ties; repeated rows are
    drawn each, in any order among equals.  Empty tables: no rows, or gains against an empty target.
    Other columns are not read."""
    features = stored(featured(docs, key, buckets, longest), "features")
    gain = gains(tally(features, buckets), tally(featured(target, None, buckets, longest), buckets))
    rows = stored(weighed(features, gain, seed), "weighed")
    able, n = ranked(rows.filter(F.col("n_words") >= least_words), segments)
    drawn = able.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
