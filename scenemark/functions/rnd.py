"""Randomness that depends on content only.

Every draw is a function of ``md5(seed:key…)``: the same rows give the same sample
whatever the partitioning, and a lost task recomputes the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hash_key(seed: str, *keys) -> Column:
    """Hex digest used to order rows at random."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[_c(k).cast("string") for k in keys]))


def hash_int(seed: str, *keys) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint")


def u01(seed: str, *keys) -> Column:
    """RND-1: uniform double in [0, 1)."""
    return hash_int(seed, *keys).cast("double") / F.lit(TWO_32)


def keep_prob(p: float, seed: str, *keys) -> Column:
    """RND-7: true with probability ``p``."""
    return u01(seed, *keys) < F.lit(p)


def pick_weighted(u: Column, weights: list[float]) -> Column:
    """RND-4: index drawn from fixed weights by comparing ``u`` with running sums."""
    total, run, out = sum(weights), 0.0, None
    for i, w in enumerate(weights[:-1]):
        run += w / total
        cond = u < F.lit(run)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(len(weights) - 1)


def shuffle_by_hash(arr: Column, seed: str, *keys) -> Column:
    """RND-5: reorder an array by the digest of (key, element)."""
    parts = [_c(k).cast("string") for k in keys]
    tagged = F.transform(
        arr,
        lambda x: F.struct(
            F.md5(F.concat_ws(":", F.lit(seed), *parts, x.cast("string"))).alias("h"), x.alias("v")
        ),
    )
    return F.transform(F.array_sort(tagged), lambda s: s["v"])


def shuffle_keep_none_last(arr: Column, seed: str, *keys) -> Column:
    """Shuffle the first three choices if the last one is a "none" choice, else all."""
    last = F.try_element_at(arr, F.lit(-1))
    return F.when(
        last.contains("none"),
        F.concat(shuffle_by_hash(F.slice(arr, 1, 3), seed, *keys), F.array(last)),
    ).otherwise(shuffle_by_hash(arr, seed, *keys))
