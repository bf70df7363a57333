"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemark.session import stored


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i and j (positions); every label is the least of its group."""
    while len(i):
        a, b = labels[i], labels[j]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels != (up := labels[labels])).any():
            labels = up
        open_ = labels[i] != labels[j]
        i, j = i[open_], j[open_]
    return labels


def _stars(links: DataFrame) -> DataFrame:
    """One round over links (hi > lo).  Large star: every higher neighbour of a node moves to
    the node's smallest neighbour.  Small star: the same among lower neighbours.  Minima are
    aggregated map-side, so a hub costs one row per task."""
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    near = both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.col("node")).alias("root"))
    large = both.filter("lo > hi").join(near, F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    large = large.filter("hi <> lo").distinct()
    low = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    small = large.join(low, F.col("hi") == F.col("node"))
    moved = small.select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    return moved.union(low.select("node", "root")).filter("hi <> lo").distinct()


def _state(links: DataFrame):
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; ``root`` is the smallest node reachable.

    Rounds (logarithmic in practice) are stored tables; a round that changes nothing ends the
    loop.  Nothing but a count and a checksum reaches the driver.  NULL ends and loops are
    ignored; an empty link table gives an empty result."""
    pair = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now = stored(pair.filter(f"{a} <> {b}").distinct(), "links")
    state = _state(now)
    while state[0]:
        now = stored(_stars(now), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
