"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(col) -> Column:
    """Round half away from zero at 6 places via the scaled double.

    Spark's ``round(x, 6)`` rounds the shortest decimal string of x, so a value
    printed as ...5 in the 7th place can round differently from engines that
    round ``x * 1e6``; rounding the scaled value keeps results engine-neutral.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * F.lit(1e6)) / F.lit(1e6)
