"""SimHash near-duplicates by generalised pigeonhole search.

Sixty-four-bit fingerprints within ``RADIUS`` differing bits are linked, all of them.  Bits that
vary together are put into the same of ``PARTS`` partitions; a dynamic program gives every
partition its own threshold so that the estimated number of probes and candidates is least.
With thresholds t1..tm that satisfy sum(t + 1) = RADIUS + 1, two fingerprints within the radius
differ by at most t_i bits in some partition i (else they would differ by RADIUS + 1), so
probing every partition within its threshold misses nothing; candidates are verified on all
64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemark.llm.graph import components, merge_labels
from scenemark.session import stored, work_partitions

WORDS = 4
SEED = 42
RADIUS = 4
PARTS = 3
#: Rows of one probe bucket that a task compares at once; fuller buckets are cut into blocks.
BLOCK = 4096
#: Fingerprints whose pairwise distances estimate the candidate counts.
ESTIMATE = 2000


# --- fingerprints -------------------------------------------------------------------------


def shingle_hashes(found: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the runs of ``words`` words, in order; of all words where there are fewer."""
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = max(0, len(found) - words)
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: last + 1], stops)), np.uint64, last + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of one UTF-8 text; zero where it has no word."""
    return majority(shingle_hashes(text.lower().split(), words, seed))  # bytes: A-Z only, split at \x20 and \x09-\x0D


def _fingerprint_batches(at: int, columns: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), *batch.columns[:columns]], names=["fp", *batch.schema.names[:columns]])

    return run


def with_fingerprint(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns as c0, c1, ... and ``fp`` (bits of the fingerprint as a long)."""
    types = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField("fp", T.LongType()), *[T.StructField(f"c{i}", types[c]) for i, c in enumerate(columns)]])
    sent = columns if "text" in columns else [*columns, "text"]  # texts travel once
    given = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    return given.mapInArrow(_fingerprint_batches(sent.index("text"), len(columns)), schema)


# --- partitions and thresholds --------------------------------------------------------------


def _comoments(batches):
    ones, both, n = np.zeros(64, np.int64), np.zeros((64, 64), np.int64), 0
    for batch in batches:
        prints = np.asarray(batch.column(0)).view("<u8")
        for at in range(0, len(prints), 65536):
            bits = np.unpackbits(prints[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            ones += bits.sum(0).astype(np.int64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
    if n:
        at = np.repeat(np.arange(64), 64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((at * 64 + np.tile(np.arange(64), 64), [4096 + 64]))), pa.array(np.concatenate((both.ravel(), [n])))],
            names=["cell", "n"],
        )


def partition_bits(prints: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bits grouped by correlation over all fingerprints: from the least settled bit on, each
    group takes the bits most correlated with those it has.  4,097 sums reach the driver."""
    sums = prints.select("fp").mapInArrow(_comoments, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(4096 + 65)
    for row in sums:
        table[row.cell] = row.n
    n, both = max(table[4096 + 64], 1.0), table[:4096].reshape(64, 64)
    mean = both.diagonal() / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    near = np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))
    free = set(range(64))
    groups = []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(sorted(free), key=lambda b: spread[b])]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: near[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _masks(bits: list[int], radius: int) -> list[int]:
    """All flips of at most ``radius`` of the bits; none for a negative radius."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]


def thresholds(sample: np.ndarray, total: int, groups: list[list[int]], radius: int = RADIUS) -> list[int]:
    """Threshold per partition (-1: not probed), least in estimated cost, by dynamic
    programming over the units t + 1.  Cost: rows probed and candidate pairs met."""
    n = len(sample)
    differ = (sample[:, None] ^ sample[None, :])[np.triu_indices(n, 1)] if n > 1 else np.zeros(1, np.uint64)
    cost = []
    for bits in groups:
        apart = np.bitwise_count(differ & np.uint64(sum(1 << b for b in bits)))
        at = [0.0]
        for t in range(radius + 1):
            met = float((apart <= t).mean()) * total * total / 2
            at.append(total * len(_masks(bits, t)) + met / 64)  # a comparison costs far less than a row
        cost.append(at)
    best = {0: (0.0, [])}
    for at in cost:
        step = {}
        for spent, (value, chosen) in best.items():
            for units in range(radius + 2 - spent):
                option = (value + at[units], [*chosen, units - 1])
                if spent + units not in step or option < step[spent + units]:
                    step[spent + units] = option
        best = step
    return best[radius + 1][1]


# --- probing --------------------------------------------------------------------------------


def joined(key: np.ndarray, prints: np.ndarray, home: np.ndarray, radius: int):
    """A spanning forest of the links inside runs of equal keys, as two arrays of positions."""
    labels = np.arange(len(key))
    at, step = np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[(home[at] | home[at + step]) & (np.bitwise_count(prints[at] ^ prints[at + step]) <= radius)]
        near = near[labels[near] != labels[near + step]]
        if len(near):
            labels = merge_labels(labels, near, near + step)
    moved = np.flatnonzero(labels != np.arange(len(key)))
    return moved, labels[moved]


def _linked(key: np.ndarray, prints: np.ndarray, home: np.ndarray, radius: int):
    """A spanning forest of the links inside runs of equal keys: (print, print) pairs."""
    a, b = joined(key, prints, home, radius)
    return prints[a], prints[b]


def _link_batches(radius: int):
    def run(batches):
        rest = None
        for batch in batches:
            key, prints, home = (np.asarray(batch.column(i)) for i in range(3))
            home = np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            if rest is not None:
                key, prints, home = (np.concatenate(x) for x in zip(rest, (key, prints, home)))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = key[cut:], prints[cut:], home[cut:]
            yield from _forest(key[:cut], prints[:cut], home[:cut], radius)
        if rest is not None:
            yield from _forest(*rest, radius)

    return run


def _forest(key, prints, home, radius):
    a, b = _linked(key, prints.view(np.uint64), home, radius)
    open_ = a != b
    if open_.any():
        yield pa.RecordBatch.from_arrays([pa.array(a[open_].view(np.int64)), pa.array(b[open_].view(np.int64))], names=["a", "b"])


def links(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` of each other.

    ``prints`` has distinct fingerprints ``fp``.  Every fingerprint is at home in its bucket of
    each probed partition and visits the buckets within the partition's threshold.  Buckets
    are sorted runs of a partition's rows, compared with numpy; a run yields a spanning forest,
    never all its pairs.  A bucket fuller than ``block`` is cut into blocks and every pair of
    blocks is a task's run of its own, so no bucket is one task's work."""
    total = prints.count()
    share = min(1.0, ESTIMATE / max(total, 1))
    cut = int(share * 2.0**63)
    sample = prints.filter(F.abs(F.xxhash64("fp", F.lit("estimate")).bitwiseAND((1 << 63) - 1)) < cut) if share < 1 else prints
    sample = np.array([r.fp for r in sample.select("fp").limit(4 * ESTIMATE).collect()], np.int64).view(np.uint64)
    groups = partition_bits(prints, parts)
    radii = thresholds(np.sort(sample), total, groups, radius)

    long = lambda bits: bits - (1 << 64) if bits >= 1 << 63 else bits
    probes = [
        F.struct(F.lit(i).alias("part"), F.lit(long(sum(1 << b for b in bits))).alias("mask"), F.lit(long(flip)).alias("flip"), F.lit(flip == 0).alias("home"))
        for i, (bits, t) in enumerate(zip(groups, radii))
        for flip in _masks(bits, t)
    ]
    at = F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip"))
    visits = prints.select("fp", F.explode(F.array(*probes)).alias("p")).select("p.part", at.alias("bucket"), "fp", "p.home")

    # fullness of the buckets that can be over a block: homes, then what comes from each home
    flips = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(long(flip)).alias("flip")) for i, (bits, t) in enumerate(zip(groups, radii)) for flip in _masks(bits, t)])
    own = visits.filter("home").groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block // 64)
    full = (
        own.select("part", "bucket", "n", F.explode(flips).alias("f"))
        .filter("f.part = part")
        .groupBy("part", F.col("bucket").bitwiseXOR(F.col("f.flip")).alias("bucket"))
        .agg(F.ceil(F.sum("n") / block).cast("int").alias("cuts"))
        .filter("cuts > 1")
    )
    full = stored(full, "full")
    cut_of = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, cut_of).alias("x"), F.greatest(k, cut_of).alias("y")))
    placed = visits.join(full, ["part", "bucket"], "left").select(
        "part", "bucket", "fp", "home", F.explode(F.when(F.col("cuts").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(others)).alias("k")
    )
    key = F.xxhash64("part", "bucket", "k.x", "k.y").alias("key")  # rows of two buckets under one key are only compared needlessly
    runs = placed.select(key, "fp", "home").repartition(work_partitions(prints), "key").sortWithinPartitions("key")
    return runs.mapInArrow(_link_batches(radius), "a long, b long")


def classes(printed: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, n, first, keep): rows and smallest ``key`` of every distinct fingerprint, and the
    smallest ``key`` of all fingerprints reachable by links."""
    groups = stored(printed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")), "prints")
    linked = stored(links(groups, radius), "links")
    roots = stored(components(linked, "a", "b"), "roots")
    least = roots.join(groups, roots.node == groups.fp).groupBy("root").agg(F.min("first").alias("keep"))
    found = roots.join(least, "root").select(F.col("node").alias("fp"), "keep")
    return groups.join(found, "fp", "left").select("fp", "n", "first", F.coalesce("keep", "first").alias("keep"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest
    ``key`` reachable over links, its own included), ``group_size`` (documents of the same
    fingerprint), ``kept``.

    NULL and wordless texts have fingerprint zero and are linked like any other.  Repeated
    rows give repeated results; a NULL key never names a component unless all its keys are
    NULL.  Other columns of ``docs`` are not read; an empty table gives no rows."""
    printed = stored(with_fingerprint(docs, [key]), "printed")
    found = printed.join(classes(printed, "c0", radius), "fp", "left")
    return found.select(
        F.col("c0").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("keep").alias("component_id"),
        F.col("n").alias("group_size"),
        F.col("c0").eqNullSafe(F.col("keep")).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of every near-duplicate component, the one of smallest ``key``;
    columns as given.  Repeated rows with that key all stay (exact deduplication comes before)."""
    names = docs.columns
    own = f"c{names.index(key)}"
    printed = stored(with_fingerprint(docs, names), "printed")
    found = classes(printed.select("fp", own), own, radius).filter("n > 1 OR NOT first <=> keep")
    copies = printed.select("fp", own).join(found.select("fp", "keep"), "fp").filter(~F.col(own).eqNullSafe(F.col("keep")))
    gone = stored(copies.select(F.col("fp").alias("_fp"), F.col(own).alias("_key")), "gone").hint("merge")
    out = printed.join(gone, (printed["fp"] == gone["_fp"]) & printed[own].eqNullSafe(gone["_key"]), "left_anti")
    return out.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
