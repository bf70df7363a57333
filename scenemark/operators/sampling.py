"""Sampling, shuffling and numbering of whole tables.

Row ranks never come from one sorted task.  A digest is uniform, so its first
characters split any group, however hot, into buckets whose order is known: ranks
are bucket offsets (a small aggregate) plus ranks inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemark.functions.rnd import _c, hash_key, u01
from scenemark.session import cut_lineage, stored, work_partitions

BUCKET_CHARS = 4
SALTS = 64


def top_k(df: DataFrame, group: list, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group, in two steps: the first ``k`` of every salted part of a
    group, then of what is left, so that a hot group is cut down by many tasks."""
    salted = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    near = Window.partitionBy(*[_c(g) for g in group], "_part").orderBy(*order)
    whole = Window.partitionBy(*[_c(g) for g in group]).orderBy(*order)
    first = salted.withColumn("_rn", F.row_number().over(near)).filter(F.col("_rn") <= k)
    return first.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= k).drop("_rn", "_part")


def hash_rank(df: DataFrame, group: list[str], keys: list[str], seed: str, name: str = "rank") -> DataFrame:
    """Dense 1-based rank of every row in digest order within its group.

    ``keys`` must identify a row.  Cost: one small aggregate and one shuffle on
    (group, bucket); a hot group is spread over 16^4 buckets.
    """
    tagged = df.withColumn("_h", hash_key(seed, *keys)).withColumn(
        "_b", F.substring("_h", 1, BUCKET_CHARS)
    )
    sizes = tagged.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    cond = F.col("_b") == F.col("_ob")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *keys)
    ranked = tagged.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(offsets, cond)
        .withColumn(name, (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_h", "_b", "_ob", "_off", "_rn", *[f"_g{i}" for i in range(len(group))])
    )


def _sorted_runs(df: DataFrame, group: list[str], order: Column, ties: list[str]) -> DataFrame:
    """The table in the order of (group, order, ties), range-partitioned and written once to the
    shared folder, with ``_mid`` (increases within a partition) and ``_p`` (the partition).

    Ranges are cut by the values themselves, ties included, so neither an outlier nor one very
    common value fills a partition.  The order column keeps its type; NULLs come first."""
    keys = [*group, "_o", *ties]
    parts = work_partitions(df)
    placed = df.withColumn("_o", order).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stored(placed.withColumn("_mid", F.monotonically_increasing_id()), "sorted").withColumn("_p", F.shiftright("_mid", 33))


def _with_runs(placed: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """Join facts about (group, partition) runs, a few per partition, to their rows."""
    named = runs.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_p").alias("_rp"), *[c for c in runs.columns if c not in (*group, "_p")])
    cond = F.col("_p") == F.col("_rp")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(named, cond).drop("_rp", *[f"_g{i}" for i in range(len(group))])


def forward_fill(df: DataFrame, group: list[str], order: Column, value: str, ties: list[str], default) -> DataFrame:
    """Last non-NULL value so far within a group; a group is filled by as many tasks as it has
    partitions, and only the ends of its runs travel."""
    placed = _sorted_runs(df, group, order, ties)
    ends = placed.groupBy(*group, "_p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_mid"))).alias("_end"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*group, "_p", F.last("_end", True).over(before).alias("_carry"))
    inside = Window.partitionBy(*group, "_p").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("_cur", F.last(value, True).over(inside))
    return _with_runs(filled, carry, group).withColumn(value, F.coalesce("_cur", "_carry", F.lit(default))).drop("_o", "_mid", "_p", "_cur", "_carry")


def ordered_rank(df: DataFrame, group: list[str], order: Column, ties: list[str], name: str = "seq") -> DataFrame:
    """Dense 1-based rank in the order of a column within each group, NULLs first: the place in
    the sorted run plus the sizes of the group's earlier runs."""
    placed = _sorted_runs(df, group, order, ties)
    runs = placed.groupBy(*group, "_p").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*group, "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.col("_mid") - F.col("_first") + F.col("_off") + 1
    return _with_runs(placed, offsets, group).withColumn(name, rank.cast("bigint")).drop("_o", "_mid", "_p", "_first", "_off")


def running_sum(df: DataFrame, group: list[str], order: Column, ties: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row in the order of a column within each group: the sum
    inside the sorted run plus those of the group's earlier runs.  One stored sort."""
    placed = _sorted_runs(df.withColumn(name, value), group, order, ties)
    runs = placed.groupBy(*group, "_p").agg(F.sum(name).alias("_n"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*group, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*group, "_p").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    summed = _with_runs(placed.withColumn("_cur", F.sum(name).over(inside)), offsets, group)
    return summed.withColumn(name, F.col("_cur") + F.col("_off")).drop("_o", "_mid", "_p", "_cur", "_off")


def sample_k(df: DataFrame, group: list[str], k: int, seed: str, keys: list[str]) -> DataFrame:
    """RND-2: ``min(k, n)`` rows of each group without replacement."""
    return top_k(df, group, [hash_key(seed, *keys), *[F.col(c) for c in keys]], k)


def sample_global(df: DataFrame, k: int, seed: str, keys: list[str]) -> DataFrame:
    """RND-2 for the whole table: top-k without a full sort."""
    return df.orderBy(hash_key(seed, *keys), *keys).limit(k)


def weighted_key(weight: Column, seed: str, *keys) -> Column:
    """Exponential key: taking the smallest keys draws without replacement by weight."""
    u = u01(seed, *keys)
    return F.when(weight > 0, -F.log(F.greatest(u, F.lit(2.0**-33))) / weight).otherwise(F.lit(float("inf")))


def sample_weighted(
    df: DataFrame, group: list[str], weight: str, k: int, seed: str, keys: list[str]
) -> DataFrame:
    """RND-3: weighted sample without replacement per group."""
    key = weighted_key(F.col(weight).cast("double"), seed, *keys)
    return top_k(df.withColumn("_wk", key), group, [F.col("_wk"), *[F.col(c) for c in keys]], k).drop("_wk")


def shuffle_rows(df: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """RND-6: random order by a range-partitioned sort on the digest."""
    return df.orderBy(hash_key(seed, *keys), *keys)


def quota_sample(
    df: DataFrame, stratum: str, targets: DataFrame, seed: str, keys: list[str]
) -> DataFrame:
    """RND-8: up to ``target`` rows of each stratum; ``targets(stratum, target)`` is a
    dimension with one row per stratum."""
    ranked = hash_rank(df, [stratum], keys, seed, "_rank")
    return ranked.join(targets, stratum).filter(F.col("_rank") <= F.col("target")).drop("_rank", "target")


def few_shot(test: DataFrame, train: DataFrame, k: int, seed: str, test_key: str, train_keys: list[str]) -> DataFrame:
    """RND-9: ``k`` distinct train rows for every test row, by an equi-join.

    Train rows get dense numbers 0..N-1; each test row draws 4k numbers by hash, keeps
    the first k distinct ones and falls back on consecutive numbers where draws collide.
    """
    numbered = hash_rank(train, [], train_keys, seed + ":train", "_tid").withColumn("_tid", F.col("_tid") - 1)
    n = train.agg(F.count(F.lit(1)).alias("_n"))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(4 * k - 1)),
        lambda i: F.conv(
            F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(test_key).cast("string"), i.cast("string"))), 1, 8),
            16,
            10,
        ).cast("bigint")
        % F.col("_n"),
    )
    spare = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.element_at("_draw", 1) + i) % F.col("_n"))
    picked = (
        test.crossJoin(F.broadcast(n))
        .withColumn("_draw", F.array_distinct(draws))
        .withColumn("_draw", F.array_distinct(F.concat(F.col("_draw"), spare)))
        .select(test_key, F.posexplode(F.slice("_draw", 1, k)).alias("shot", "_tid"))
    )
    return picked.join(numbered, "_tid").drop("_tid")


def with_seq_id(df: DataFrame, order: list, name: str = "id", start: int = 0) -> DataFrame:
    """ID-1: dense ids in the order of ``order``.

    A range-partitioned sort is written once to the shared folder; partition sizes give
    the offsets, so no row passes through a single task.
    """
    mid = F.monotonically_increasing_id()
    placed = cut_lineage(df.orderBy(*order).withColumn("_mid", mid)).withColumn(
        "_p", F.shiftright("_mid", 33)
    )
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the sort: the window input is as small as the partition count
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_p")
        .withColumn(name, (local + F.col("_off") + F.lit(start)).cast("bigint"))
        .drop("_mid", "_p", "_off")
    )


def slice_ids(df: DataFrame, start: int | None, end: int | None, col: str = "id") -> DataFrame:
    """FLT-1 / FLT-2: keep ids in [start, end); reaches the parquet scan."""
    if start is not None:
        df = df.filter(F.col(col) >= start)
    if end is not None:
        df = df.filter(F.col(col) < end)
    return df


def chunk(df: DataFrame, n: int, k: int, seq: str = "id") -> DataFrame:
    """PRT-1: k-th of n near-equal chunks of a densely numbered table."""
    total = df.agg(F.ceil(F.count(F.lit(1)) / F.lit(n)).alias("_size"))
    return df.crossJoin(F.broadcast(total)).filter(F.floor(F.col(seq) / F.col("_size")) == k).drop("_size")
