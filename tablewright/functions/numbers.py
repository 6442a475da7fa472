"""Number helpers (MTH-3, MTH-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and suffixes of the short number format.
MILLION, THOUSAND = 1e6, 1e3


def human_number(c: Column) -> Column:
    """MTH-6: ``1.23M``, ``4.56K``, ``1,234.50``-style text; NULL -> ``N/A``.

    ``format_number`` rounds the exact binary value half-to-even, as
    Python's and C's ``%.2f`` do (``format_string`` rounds the shortest
    decimal text half-up instead); its grouping commas are removed in the
    scaled branches.
    """
    x = c.cast("double")

    def two(v: Column) -> Column:
        return F.regexp_replace(F.format_number(v, 2), ",", "")

    return (F.when(x.isNull(), F.lit("N/A"))
            .when(F.abs(x) >= MILLION, F.concat(two(x / MILLION), F.lit("M")))
            .when(F.abs(x) >= THOUSAND, F.concat(two(x / THOUSAND), F.lit("K")))
            .otherwise(F.format_number(x, 2)))


def safe_divide(a: Column, b: Column) -> Column:
    """MTH-3: NULL instead of an error for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))
