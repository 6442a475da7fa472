"""Column type families and argument checks (CHK-4).

Every operator validates its arguments against ``df.schema`` before it
builds a plan, so bad input fails at call time, before any job runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
STRING_TYPES = (T.StringType, T.VarcharType, T.CharType)


class OperatorError(ValueError):
    """Raised for bad operator arguments (unknown column, bad option...)."""


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType, include_bool: bool = False) -> bool:
    if include_bool and isinstance(dt, T.BooleanType):
        return True
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, STRING_TYPES)


def family(dt: T.DataType) -> str:
    """Type family used for dtype selection and profiles.

    ``number`` excludes booleans, as a numeric dtype selection does.
    """
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_numeric(dt):
        return "number"
    if is_datetime(dt):
        return "datetime"
    if is_string(dt):
        return "object"
    return "other"


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType, include_bool)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not is_numeric(f.dataType) and not is_datetime(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "Column") -> list[str]:
    cols = as_list(columns)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise OperatorError(
            f"{what}(s) not found: {', '.join(map(str, missing))}; "
            f"available: {', '.join(df.columns)}")
    return cols


def require_numeric(df: DataFrame, columns: Iterable[str]) -> list[str]:
    cols = require_columns(df, columns)
    bad = [c for c in cols if not is_numeric(dtype_of(df, c))]
    if bad:
        raise OperatorError(f"Column(s) must be numeric: {', '.join(bad)}")
    return cols


def require_string(df: DataFrame, columns: Iterable[str]) -> list[str]:
    cols = require_columns(df, columns)
    bad = [c for c in cols if not is_string(dtype_of(df, c))]
    if bad:
        raise OperatorError(f"Column(s) must be text: {', '.join(bad)}")
    return cols


def require_batch(df: DataFrame, op: str) -> None:
    """Global-statistics and ordered operators need the whole table."""
    if df.isStreaming:
        raise OperatorError(f"{op} needs a bounded table; it is batch only")


def q(name: str) -> str:
    """Back-quote a column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def normalize_nan(df: DataFrame, columns=None) -> DataFrame:
    """Turn floating NaN into NULL (in ``columns``), so only NULL means missing."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (columns is None or f.name in columns):
            c = col(f.name)
            exprs.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType))
                         .otherwise(c).alias(f.name))
        else:
            exprs.append(col(f.name))
    return df.select(*exprs)
