"""Mixing sources to target weights by hierarchical budgets.

Leaves are the distinct values of the level columns (domain, language, source).  A budget of
tokens goes down the tree: the children of a node share its budget by weight, a child that
has too few tokens gets all it has, and what it leaves over is shared by its siblings; only
what a whole subtree cannot use reaches the subtree's own siblings, because a node asks for no
more than its leaves hold.  Each leaf's budget is a prefix of its token stream: epoch after
epoch, each in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemark.session import stored

#: Rows of a leaf that one task puts in order.
BUCKET_ROWS = 20_000
NULL = "(null)"


def words() -> Column:
    """Words of ``text``: runs of anything but space and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _weight(path: Column, weights: dict[str, float]) -> Column:
    """Weight of a node by its path; one where none is given."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, path), F.lit(1.0))


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, float], share: float, epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, rows) with ``budget``, whole tokens.

    The tree's budget is ``share`` of all tokens; a leaf can give ``epochs`` times its tokens,
    and none where a weight on its path is zero.  ``weights`` maps node paths
    ("web/en") to weights."""
    path = lambda n: F.concat_ws("/", *levels[:n])
    weighed = leaves
    for n in range(1, len(levels) + 1):
        weighed = weighed.withColumn(f"_w{n}", _weight(path(n), weights))
    usable = F.least(*[F.col(f"_w{n}") for n in range(1, len(levels) + 1)], F.lit(1.0)) > 0
    weighed = weighed.withColumn("_cap", F.when(usable, F.col("tokens") * float(epochs)).otherwise(0.0))
    # the budget of a node is repeated on its leaves while it goes down
    root = Window.partitionBy(F.lit(0))
    now = weighed.withColumn("_b", F.least(F.floor(F.sum("tokens").over(root) * share).cast("double"), F.sum("_cap").over(root)))
    for n in range(1, len(levels) + 1):
        nodes = now.groupBy(*levels[:n]).agg(F.sum("_cap").alias("_cap"), F.max(f"_w{n}").alias("_w"), F.max("_b").alias("_b"))
        order = [F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(float("inf")), *levels[:n]]
        above = Window.partitionBy(*levels[: n - 1]) if n > 1 else Window.partitionBy(F.lit(0))
        before = above.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        after = above.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        placed = nodes.withColumn("_left", F.col("_b") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(after))
        full = F.col("_cap") * F.col("_rest") <= F.col("_w") * F.col("_left")
        level = F.first(F.when(~full & (F.col("_rest") > 0), F.col("_left") / F.col("_rest")), ignorenulls=True)
        placed = placed.withColumn("_full", full).withColumn("_level", level.over(above.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        given = placed.select(*levels[:n], F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))).alias("_b"))
        now = now.drop("_b").join(given, levels[:n])
    return now.select(*leaves.columns, F.floor(F.coalesce("_b", F.lit(0.0)) + 1e-6).cast("bigint").alias("budget"))


def _order(seed: str, epoch: Column, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def select(rows: DataFrame, levels: list[str], leaves: DataFrame, seed: str, key: str = "doc_id") -> DataFrame:
    """(key, levels, tokens, epoch, used) for every row and epoch in which it is used.

    A leaf with budget b and T tokens gives all its rows in each of the b // T first epochs; in
    the next one the rows, in the order of a digest of seed, epoch and key, that start within
    the b % T remaining tokens; the last of these is used in part.  The digest cuts a leaf of
    any size into buckets of known order, so only bucket sums are added up in one place."""
    budget = leaves.select(
        *levels, F.col("rows").alias("_n"),
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("_whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("_part"),
    )
    found = rows.join(budget, levels).withColumn("_h", _order(seed, F.col("_whole"), key))
    spot = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 4294967296.0
    found = found.withColumn("_k", F.floor(spot * F.ceil(F.col("_n") / BUCKET_ROWS)).cast("int"))
    sums = found.groupBy(*levels, "_k").agg(F.sum("tokens").alias("_s"))
    earlier = Window.partitionBy(*levels).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*levels, "_k", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*levels, "_k").orderBy("_h", key, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = found.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, [*levels, "_k"])
    begin = F.col("_off") + F.col("_in")
    used = F.greatest(F.lit(0), F.least("tokens", F.col("_part") - begin))
    last = F.when(begin < F.col("_part"), F.array(F.struct(F.col("_whole").alias("epoch"), used.cast("bigint").alias("used"))))
    whole = F.when(F.col("_whole") > 0, F.transform(F.sequence(F.lit(0), F.col("_whole") - 1), lambda e: F.struct(e.alias("epoch"), F.col("tokens").alias("used"))))
    none = F.array().cast("array<struct<epoch:int,used:bigint>>")
    uses = F.explode(F.concat(F.coalesce(whole, none), F.coalesce(last, none)))
    return at.select(key, *levels, "tokens", uses.alias("_u")).select(key, *levels, "tokens", "_u.epoch", "_u.used")


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, float], share: float, epochs: int = 1,
    seed: str = "mix", key: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """Uses of documents (see ``select``) so that token sums follow ``weights``.

    ``levels`` names the tree's columns from the root down.  NULL levels are nodes named
    "(null)"; texts without tokens are used with zero tokens where they fall within a prefix;
    repeated rows are used each for itself; an empty table gives no rows.  Of other columns
    only those that the expressions name are read."""
    names = list(levels)
    given = docs.select(F.col(key), *[F.coalesce(c.cast("string"), F.lit(NULL)).alias(n) for n, c in levels.items()], (words() if tokens is None else tokens).alias("tokens"))
    rows = stored(given, "rows")
    leaves = stored(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    return select(rows, names, stored(budgets(leaves, names, weights, share, epochs), "budgets"), seed, key)


def keep_mixed(docs: DataFrame, levels: dict[str, Column], weights: dict[str, float], share: float, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """``docs`` that a mix of one epoch uses, whole (the last of a leaf too); columns as given."""
    used = stored(mix(docs, levels, weights, share, 1, seed, key).select(F.col(key).alias("_key")).distinct(), "used").hint("merge")
    return docs.join(used, docs[key].eqNullSafe(used["_key"]), "left_semi")
