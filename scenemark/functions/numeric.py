"""Rounding that does not depend on summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenemark.functions.rnd import _c


def rnd(col, dp: int) -> Column:
    """Half-up rounding of a double after dropping noise below 12 decimals."""
    return F.round(_c(col).cast("decimal(38,12)"), dp).cast("double")


def fixed(col, dp: int) -> Column:
    """Fixed-point text, ties to even."""
    return F.format_string(f"%.{dp}f", F.bround(_c(col).cast("double"), dp))
