"""Range classes and label resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions.rnd import _c


def range_class(col, table: dict[str, list[float]]) -> Column:
    """CAP-10: first class whose range holds the value, both ends inclusive; '' otherwise."""
    out = None
    for name, (lo, hi) in table.items():
        cond = (_c(col) >= float(lo)) & (_c(col) <= float(hi))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("")


def range_class_open(col, table: dict[str, list[float]]) -> Column:
    """Ranges open below and closed above; NULL otherwise."""
    out = None
    for name, (lo, hi) in table.items():
        cond = (_c(col) > float(lo)) & (_c(col) <= float(hi))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def range_class_join(df, col: str, table, name: str = "label"):
    """CAP-10 for class tables that are user data: (label, lo, hi, ord), a dimension.  It becomes
    one row with the classes in order, in which each row of ``df`` finds its first fit."""
    one = table.agg(F.sort_array(F.collect_list(F.struct("ord", "label", "lo", "hi"))).alias("_classes"))
    fits = F.filter("_classes", lambda c: (F.col(col) >= c["lo"]) & (F.col(col) <= c["hi"]))
    return df.crossJoin(one).withColumn(name, F.coalesce(F.get(fits, 0)["label"], F.lit(""))).drop("_classes")


def by_priority(labels: Column, order: list[str]) -> Column:
    """CAP-11: the label with the highest priority (last in ``order``); '' if none."""
    rank = F.array(*[F.lit(x) for x in order])
    known = F.filter(labels, lambda v: F.array_contains(rank, v))
    best = F.array_max(F.transform(known, lambda v: F.struct(F.array_position(rank, v).alias("p"), v.alias("v"))))
    return F.coalesce(best["v"], F.lit(""))


def last_true(cases: list[tuple[Column, str]]) -> Column:
    """CAP-11: label of the last condition that holds; ''."""
    out = F.lit("")
    for cond, label in cases:
        out = F.when(cond, label).otherwise(out)
    return out


def comma_join(*parts: Column) -> Column:
    """CAP-11: the non-empty parts joined by commas."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def ordinal(n) -> Column:
    """CAP-21: 0 -> first … 99 -> one hundredth; NULL beyond."""
    return F.get(F.array(*[F.lit(w) for w in dims.ORDINALS]), _c(n).cast("int"))
