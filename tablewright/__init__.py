"""tablewright: table preparation and exploration operators on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` (reports return
small DataFrames); see ``tablewright.operators``.
"""

from .operators import aggregate, analytics, charts, cleaning, joins, quantile, selection, transform
from .session import get_spark

__all__ = ["aggregate", "analytics", "charts", "cleaning", "joins", "quantile", "selection",
           "transform", "get_spark"]
