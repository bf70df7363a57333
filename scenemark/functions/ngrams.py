"""Tokens and n-grams of a text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of word characters and single marks, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def ngrams(words: Column, most: int = 4) -> Column:
    """Array of struct(n, gram) of all runs of one to ``most`` words."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        run = lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram"))
        return F.when(F.size(words) >= n, F.transform(starts, run)).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    return F.concat(*[runs(n) for n in range(1, most + 1)])
