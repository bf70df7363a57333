"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the nearest
vertex of the cross-polytope (largest coordinate and its sign) is its hash.  ``FUNCTIONS``
hashes make a bucket, and in each of ``TABLES`` tables a vector enters its ``PROBES`` cheapest
buckets: those a small turn could have put it into.  Vectors that share a bucket are compared by
cosine in double precision; a pair is counted where its smallest common bucket is, so once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemark.llm.graph import components, merge_labels
from scenemark.session import stored, work_partitions

TABLES = 4
FUNCTIONS = 2
PROBES = 4
#: Vectors of a bucket that one run compares; fuller buckets are cut into blocks, and every
#: pair of blocks is a run of its own.
BLOCK = 1024
#: Rows of a run that meet all later ones at a time.
STEP = 64
COSINE = 0.98


# --- hashing --------------------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, d = x.shape
    half = 1
    while half < d:
        pair = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=32)
def _signs(d: int, tables: int, functions: int) -> np.ndarray:
    return np.random.default_rng(d * 1_000_003 + tables * 101 + functions).choice((-1.0, 1.0), (tables, functions, 3, d))


def codes(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES) -> np.ndarray:
    """Bucket codes of unit rows, ``probes`` per table, cheapest first; codes of different
    tables differ."""
    n, width = x.shape
    d = 1 << max(1, (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - width)))
    near = min(max(2, probes), d)
    found = []
    for table in _signs(d, tables, functions):
        cost, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for rounds in table:
            y = x
            for signs in rounds:
                y = hadamard(y * signs)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            size = np.take_along_axis(y, top, 1)
            vertex = 2 * top + (size < 0)
            more = (np.abs(size[:, :1]) - np.abs(size)) ** 2
            cost = (cost[:, :, None] + more[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * d) + vertex[:, None, :]).reshape(n, -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, : max(probes, 1)]
            cost, code = np.take_along_axis(cost, keep, 1), np.take_along_axis(code, keep, 1)
        found.append(code + len(found) * (1 << 48))
    return np.concatenate(found, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components keep their precision
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _code_batches(tables: int, functions: int, probes: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values, at = np.asarray(lists.values), np.asarray(lists.offsets)
            size = np.diff(at)
            made: list = [None] * len(size)
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                x = values[at[rows][:, None] + np.arange(width)]
                for row, code in zip(rows, codes(_unit(x), tables, functions, probes)):
                    made[row] = code
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int64())), *batch.columns], names=["codes", *batch.schema.names])

    return run


# --- comparing ------------------------------------------------------------------------------


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest code that rows of a and b share (they share one)."""
    same = (a[:, :, None] == b[:, None, :]).any(2)
    return np.where(same, a, np.iinfo(np.int64).max).min(1)


def _compare(run: dict, cosine: float):
    """Links of one run: (nodes, links of each), and a forest (node, node) of the links."""
    n = len(run["node"])
    counts = np.zeros(n, np.int64)
    labels = np.arange(n)
    widths = np.diff(run["at"])
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if len(rows) < 2:
            continue
        x = _unit(run["values"][run["at"][rows][:, None] + np.arange(width)])
        for start in range(0, len(rows), STEP):
            i, j = np.nonzero(x[start : start + STEP] @ x[start:].T >= cosine)
            i, j = rows[start + i], rows[start + j]
            ok = (i < j) & (run["label"][i] == run["label"][j]) & (run["code"][i] == run["code"][j])
            ok &= ~run["cross"][i] | (run["side"][i] != run["side"][j])
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 20_000):
                a, b = i[at : at + 20_000], j[at : at + 20_000]
                own = _first_shared(run["codes"][a], run["codes"][b]) == run["code"][a]
                a, b = a[own], b[own]
                np.add.at(counts, a, run["m"][b])
                np.add.at(counts, b, run["m"][a])
                open_ = labels[a] != labels[b]
                labels = merge_labels(labels, a[open_], b[open_])
    return counts, labels


def _compare_batches(cosine: float):
    names = ["key", "node", "m", "label", "code", "side", "cross"]

    def arrays(batch):
        out = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
        lists = batch.column(7)
        out["codes"] = np.asarray(lists.flatten()).reshape(len(batch), -1)
        lists = batch.column(8)
        out["widths"], out["values"] = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten())
        return out

    def cut(rows, a, b):
        at = np.concatenate(([0], np.cumsum(rows["widths"])))
        out = {k: v[a:b] for k, v in rows.items() if k != "values"}
        out["values"] = rows["values"][at[a] : at[b]]
        out["at"] = np.concatenate(([0], np.cumsum(out["widths"])))
        return out

    def runs(rows):
        key = rows["key"]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        stops = np.append(starts[1:], len(key))
        for a, b in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
            run = cut(rows, a, b)
            counts, labels = _compare(run, cosine)
            some, moved = counts > 0, np.flatnonzero(labels != np.arange(len(labels)))
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((run["node"][some], run["node"][moved]))),
                        pa.array(np.concatenate((counts[some], np.zeros(len(moved), np.int64)))),
                        pa.array(np.concatenate((run["node"][some], run["node"][labels[moved]]))),
                    ],
                    names=["node", "links", "other"],
                )

    def run_all(batches):
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = arrays(batch)
            if rest is not None:
                rows = {k: np.concatenate((rest[k], rows[k])) for k in rows}
            last = int(np.searchsorted(rows["key"], rows["key"][-1]))
            yield from runs(cut(rows, 0, last)) if last else ()
            rest = cut(rows, last, len(rows["key"]))
            rest.pop("at")
        if rest is not None:
            yield from runs(rest)

    return run_all


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", cosine: float = COSINE,
    tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, block: int = BLOCK,
) -> DataFrame:
    """(``key``, n_links, component_id, kept) per row of ``vectors``.

    Rows link with rows of an equal label and a cosine of at least ``cosine``.  Rows whose label
    or vector is NULL, or whose vector is empty, zero or holds NULL or non-finite components,
    link with nothing; vectors of different lengths do not link.  Equal rows of label and
    vector are one class: they link with each other, count fully in ``n_links``, and only
    classes are compared.  Rows that repeat a key are vectors of their own, linked where their
    vectors are.  ``component_id`` is the smallest key reachable; a row whose key is NULL has the
    smallest key of its component, or NULL.  An empty table gives no rows."""
    given = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = given.filter(valid).groupBy("label", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    kind = classes.schema["v"].dataType
    schema = T.StructType([T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("v", kind), T.StructField("node", T.LongType()), T.StructField("m", T.LongType()), T.StructField("label", T.LongType())])
    signed = classes.select("v", "node", "m", F.xxhash64("label").alias("label")).repartition(work_partitions(vectors), "node")
    coded = stored(signed.mapInArrow(_code_batches(tables, functions, probes), schema), "codes")

    entry = F.explode("codes").alias("code")
    bucket = F.xxhash64("label", F.size("v"), "code").alias("bucket")
    full = coded.select("label", "v", entry).select(bucket).groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts")).filter("cuts > 1")
    full = stored(full, "full")
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y"), (k < own).cast("int").alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    placed = (
        coded.select("*", entry).select("*", bucket).join(full, "bucket", "left")
        .select("*", F.explode(F.when(F.col("cuts").isNull(), alone).otherwise(pairs)).alias("p"))
    )
    runs = placed.select(F.xxhash64("bucket", "p.x", "p.y").alias("key"), "node", "m", "label", "code", "p.side", (F.col("p.x") != F.col("p.y")).alias("cross"), "codes", "v")
    runs = runs.repartition(work_partitions(vectors), "key").sortWithinPartitions("key")
    found = stored(runs.mapInArrow(_compare_batches(cosine), "node long, links long, other long"), "found")

    links = found.filter("node = other").groupBy("node").agg(F.sum("links").alias("links"))
    roots = stored(components(found.filter("node <> other"), "node", "other"), "roots")
    least = roots.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    placed = roots.join(least, "root").select("node", "least")
    known = classes.join(links, "node", "left").join(placed, "node", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("least", "first").alias("least")
    )
    joined = given.withColumn("v", F.when(valid, F.col("v"))).withColumn("label", F.when(F.col("v").isNotNull(), F.col("label"))).join(known, ["label", "v"], "left")
    component = F.coalesce("least", "id")
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
