"""Reshaping and feature operators (RSH-1..3, MTH-1..6, BIN-1..3, DAT-1..2).

Pivot and one-hot read their value list with one ``distinct`` first,
because the output schema depends on it; the pivot itself then runs with a
fixed value list (no second pass to discover values).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_timestamp
from ..functions.numbers import human_number  # noqa: F401  (re-export)
from ..functions.strings import strip, title_case
from ..schema import (OperatorError, as_list, col, dtype_of, is_datetime, is_numeric, is_string,
                      numeric_columns, require_batch, require_columns, require_numeric)
from . import quantile as Q
from .aggregate import _stat, group_by_agg

# Aggregate functions of pivot_table.
PIVOT_AGGS = ["mean", "sum", "count", "min", "max", "median", "std"]
# Default of the callers' bound on data-dependent output columns (pivot, one-hot).
MAX_NEW_COLUMNS = 10_000


def _not_null(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & col(c).isNotNull()
    return cond


def _distinct_sorted(df: DataFrame, columns: list[str], most: int, instead: str) -> list[tuple]:
    keys = [col(c) for c in columns]
    vals = [tuple(r) for r in df.select(*keys).where(_not_null(columns)).distinct().orderBy(*keys).limit(most + 1).collect()]
    if len(vals) > most:
        raise OperatorError(f"{', '.join(columns)}: more than {most} new columns; raise max_columns or use {instead}")
    return vals


def _pivot_values(df: DataFrame, index: list[str], columns: list[str], values, aggfunc: str) -> list[str]:
    require_columns(df, [*index, *columns])
    if not columns:
        raise OperatorError("name at least one column to pivot")
    if aggfunc not in PIVOT_AGGS:
        raise OperatorError(f"'{aggfunc}' is not one of {', '.join(PIVOT_AGGS)}")
    vals = as_list(values) or [c for c in numeric_columns(df) if c not in index + columns]
    require_columns(df, vals)
    return vals


def _cell(v: str, aggfunc: str) -> Column:
    return (F.coalesce(F.sum(col(v)), F.lit(0)) if aggfunc == "sum" else _stat(aggfunc, col(v))).alias(v)


def pivot_table(df: DataFrame, index, columns, values=None, aggfunc: str = "mean", max_columns: int = MAX_NEW_COLUMNS) -> DataFrame:
    """RSH-1: index columns x values of one or more columns -> aggregate; NULL keys dropped.

    With one value column given as a string the new columns are named by
    the pivoted values (``a_b`` for two pivot columns); otherwise
    ``{value}_{column value}``.  ``pivot_cells`` has the same cells as rows, for
    any number of pivoted values.
    """
    require_batch(df, "pivot_table")
    index, columns = as_list(index), as_list(columns)
    vals = _pivot_values(df, index, columns, values, aggfunc)
    single = isinstance(values, str)
    keyed = df.filter(_not_null(index + columns))
    pivots = _distinct_sorted(keyed, columns, max_columns, "pivot_cells")
    names = ["_".join(str(v) for v in p) for p in pivots]
    if len(set(names)) < len(names):
        raise OperatorError(f"values of {', '.join(columns)} give the same column name twice; use pivot_cells")
    exprs = [_cell(v, aggfunc) for v in vals]
    if aggfunc == "median":  # exact medians, one per cell
        keyed = group_by_agg(keyed, [*index, *columns], {v: "median" for v in vals})
        exprs = [F.first(col(v)).alias(v) for v in vals]
    if len(columns) == 1:
        grouped = keyed.groupBy(*[col(c) for c in index]).pivot(columns[0], [p[0] for p in pivots])
        keys = [str(p[0]) for p in pivots]
    else:  # a tuple of values is one text, in which no two tuples are alike
        one = F.to_json(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
        texts = {tuple(r)[:-1]: r["_tw_json"] for r in df.sparkSession.createDataFrame(
            pivots, keyed.select(*[col(c) for c in columns]).schema).select("*", one.alias("_tw_json")).collect()} if pivots else {}
        keys = [texts[p] for p in pivots]
        grouped = keyed.withColumn("_tw_pivot", one).groupBy(*[col(c) for c in index]).pivot("_tw_pivot", keys)
    grouped = grouped.agg(*exprs)
    # Spark names: "<pivot>_<value>" for several aggregates, "<pivot>" for one
    out = [col(c) for c in index]
    for key, name in zip(keys, names):
        for v in vals:
            out.append(col(key if len(vals) == 1 else f"{key}_{v}").alias(name if single else f"{v}_{name}"))
    return grouped.select(*out)


def pivot_cells(df: DataFrame, index, columns, values=None, aggfunc: str = "mean") -> DataFrame:
    """RSH-1, sparse: the pivot's cells as rows (index..., pivoted values as text, aggregates).

    Holds any number of pivoted values; a pair that never occurs has no row.
    """
    require_batch(df, "pivot_cells")
    index, columns = as_list(index), as_list(columns)
    vals = _pivot_values(df, index, columns, values, aggfunc)
    keyed = df.filter(_not_null(index + columns))
    keys = index + columns
    if aggfunc == "median":
        cells = group_by_agg(keyed, keys, {v: "median" for v in vals})
    else:
        cells = keyed.groupBy(*[col(c) for c in keys]).agg(*[_cell(v, aggfunc) for v in vals])
    return cells.select(*[col(c) for c in index], *[col(c).cast("string").alias(c) for c in columns], *[col(v) for v in vals])


def melt_unpivot(df: DataFrame, id_vars, value_vars=None, var_name: str = "variable",
                 value_name: str = "value") -> DataFrame:
    """RSH-2: wide to long; value columns of different types are cast to text."""
    ids = require_columns(df, as_list(id_vars))
    vals = require_columns(df, as_list(value_vars)) if value_vars else [
        c for c in df.columns if c not in ids]
    if not vals:
        raise OperatorError("no value columns to unpivot")
    types = {dtype_of(df, c) for c in vals}
    if len(types) > 1:
        cast_to = T.DoubleType() if all(is_numeric(t) for t in types) else T.StringType()
        df = df.withColumns({c: col(c).cast(cast_to) for c in vals})
    return df.unpivot([col(c) for c in ids], [col(c) for c in vals], var_name, value_name)


def one_hot_sparse(df: DataFrame, column: str, key, drop_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """RSH-3, sparse: ((code, value) dictionary, (key..., code) cells) for any number of values.

    Codes are the 0-based ranks of the sorted values (a distributed sort of the
    distinct values); a row's only true cell is its code, NULL has none.
    """
    require_batch(df, "one_hot_sparse")
    keys = require_columns(df, as_list(key))
    require_columns(df, [column])
    from ..order import with_position
    values = df.select(col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    codes = with_position(values, ["value"], name="code")
    if drop_first:
        codes = codes.where(F.col("code") > 0).withColumn("code", F.col("code") - 1)
    cells = df.select(*[col(k) for k in keys], col(column).alias("_tw_value")).join(codes, F.col("_tw_value") == F.col("value"))
    return codes.select("code", "value"), cells.select(*[col(k) for k in keys], "code")


def one_hot_encode(df: DataFrame, columns, drop_first: bool = False, max_columns: int = MAX_NEW_COLUMNS) -> DataFrame:
    """RSH-3: replace each column by sorted ``col_value`` booleans at the end.

    NULL gives all false; ``drop_first`` leaves out the first value;
    ``one_hot_sparse`` is for more values than ``max_columns``.
    """
    require_batch(df, "one_hot_encode")
    cols = require_columns(df, as_list(columns))
    new = []
    for c in cols:
        vals = [v for v, in _distinct_sorted(df, [c], max_columns, "one_hot_sparse")]
        if drop_first:
            vals = vals[1:]
        new += [F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in vals]
    keep = [col(c) for c in df.columns if c not in cols]
    return df.select(*keep, *new)


# ----------------------------------------------------------------- math

def _round_half_even(c: Column) -> Column:
    return F.bround(c, 0)


# The whitelist of column functions.
CUSTOM_FUNCTIONS = ["double", "square", "abs", "round", "strip", "lower", "upper", "title",
                    "to_string"]
_NUMERIC_FUNCS = {"double", "square", "abs", "round"}


def custom_function(name: str, c: Column) -> Column:
    if name == "double":
        return c * 2
    if name == "square":
        return c * c
    if name == "abs":
        return F.abs(c)
    if name == "round":
        return _round_half_even(c)
    if name == "strip":
        return strip(c)
    if name == "lower":
        return F.lower(c)
    if name == "upper":
        return F.upper(c)
    if name == "title":
        return title_case(c)
    if name == "to_string":
        return c.cast("string")
    raise OperatorError(f"Unsupported function '{name}'; choose from {', '.join(CUSTOM_FUNCTIONS)}")


def apply_custom(df: DataFrame, column: str, function: str, new_column: str | None = None) -> DataFrame:
    """MTH-1 / UDF-1: a whitelisted column function, into the same or a new column."""
    require_columns(df, [column])
    if function not in CUSTOM_FUNCTIONS:
        raise OperatorError(f"Unsupported function '{function}'")
    dt = dtype_of(df, column)
    if function in _NUMERIC_FUNCS and not is_numeric(dt):
        raise OperatorError(f"'{function}' needs a numeric column")
    if function in ("strip", "lower", "upper", "title") and not is_string(dt):
        raise OperatorError(f"'{function}' needs a text column")
    return df.withColumn(new_column or column, custom_function(function, col(column)))


# Interaction operations.
INTERACTIONS = ["multiply", "add", "subtract", "divide", "concat"]


def create_interaction(df: DataFrame, col1: str, col2: str, new_name: str,
                       operation: str = "multiply") -> DataFrame:
    """MTH-2..4: arithmetic of two numeric columns, or concatenated text."""
    require_columns(df, [col1, col2])
    if operation not in INTERACTIONS:
        raise OperatorError(f"Unsupported operation '{operation}'")
    if new_name in df.columns:
        raise OperatorError(f"Column '{new_name}' already exists")
    a, b = col(col1), col(col2)
    if operation == "concat":
        expr = F.concat(a.cast("string"), b.cast("string"))
    else:
        require_numeric(df, [col1, col2])
        if operation == "multiply":
            expr = a * b
        elif operation == "add":
            expr = a + b
        elif operation == "subtract":
            expr = a - b
        else:  # a zero divisor gives NULL, not an error
            expr = F.try_divide(a.cast("double"), b.cast("double"))
    return df.withColumn(new_name, expr)


def scale_numeric(df: DataFrame, columns=None, method: str = "standard") -> DataFrame:
    """MTH-5: standard (sample std), min-max or robust (median / IQR).

    Means/stds or mins/maxes of all columns come from one aggregate, robust
    quartiles from ``operators.quantile``; a degenerate column (zero spread)
    becomes 0.
    """
    require_batch(df, "scale_numeric")
    cols = require_numeric(df, as_list(columns)) if columns else numeric_columns(df)
    if method not in ("standard", "minmax", "robust"):
        raise OperatorError("method must be 'standard', 'minmax' or 'robust'")
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        if method == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"b{i}")]
        elif method == "minmax":
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*aggs).first() if aggs else None
    quart = Q.quantile_values(df, cols, [0.25, 0.5, 0.75]) if method == "robust" else {}
    exprs = {}
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        if method == "standard":
            center, spread = row[f"a{i}"], row[f"b{i}"]
        elif method == "minmax":
            center, spread = row[f"a{i}"], (None if row[f"a{i}"] is None else row[f"b{i}"] - row[f"a{i}"])
        else:
            qs = quart[c]
            center, spread = (None, None) if qs[1] is None else (qs[1], qs[2] - qs[0])
        if center is None:  # no values at all
            exprs[c] = F.lit(0.0)
            continue
        if spread is None or spread == 0 or (isinstance(spread, float) and math.isnan(spread)):
            exprs[c] = F.when(x.isNotNull(), F.lit(0.0)).otherwise(F.lit(0.0))
        else:
            exprs[c] = (x - F.lit(float(center))) / F.lit(float(spread))
    return df.withColumns(exprs) if exprs else df


# --------------------------------------------------------------- binning

def _cut_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width edges over [lo, hi], first edge lowered by 0.1 % of the range."""
    if lo == hi:
        adj = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - adj, hi + adj
        step = (hi - lo) / bins
        return [lo + step * i for i in range(bins)] + [hi]
    step = (hi - lo) / bins
    edges = [lo + step * i for i in range(bins)] + [hi]
    edges[0] = lo - (hi - lo) * 0.001
    return edges


def bin_expr(c: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """Right-closed bins (e_{i-1}, e_i] as 1-based numbers, by comparisons."""
    expr = None
    for i, e in enumerate(edges[1:], 1):
        cond = c <= F.lit(e)
        if i == 1:
            cond = ((c >= F.lit(edges[0])) if include_lowest else (c > F.lit(edges[0]))) & cond
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def _fmt_edge(x: float) -> str:
    return f"{x:.6g}"


def bin_numeric(df: DataFrame, column: str, bins: int = 4, labels=None, qcut: bool = False,
                new_column: str | None = None) -> DataFrame:
    """BIN-1..3: equal-width (``cut``) or quantile (``qcut``) bins.

    Adds ``{column}_binned`` (label text: the given label or ``(lo, hi]``)
    and ``{column}_bin`` (1-based bin number).  Edges come from one
    aggregate; repeated quantile edges raise.
    """
    require_batch(df, "bin_numeric")
    require_numeric(df, [column])
    if bins <= 0:
        raise OperatorError("Bins must be a positive integer")
    if labels is not None and len(labels) != bins:
        raise OperatorError("Labels length must match number of bins")
    x = col(column).cast("double")
    if qcut:
        probs = [i / bins for i in range(bins + 1)]
        qs = Q.quantile_values(df, [column], probs)[column]
        if qs[0] is None:
            raise OperatorError("no values to bin")
        edges = [float(v) for v in qs]
        if len(set(edges)) != len(edges):
            raise OperatorError("Bin edges must be unique (repeated quantiles)")
        number = bin_expr(x, edges, include_lowest=True)
    else:
        r = df.agg(F.min(x), F.max(x)).first()
        if r[0] is None:
            raise OperatorError("no values to bin")
        edges = _cut_edges(float(r[0]), float(r[1]), bins)
        number = bin_expr(x, edges)
    names = labels or [f"({_fmt_edge(edges[i])}, {_fmt_edge(edges[i + 1])}]" for i in range(bins)]
    label = F.element_at(F.array(*[F.lit(str(n)) for n in names]), number)
    target = new_column or f"{column}_binned"
    return df.withColumns({target: label, f"{column}_bin": number})


def bin_edges(df: DataFrame, column: str, bins: int = 4, qcut: bool = False) -> list[float]:
    """The edges ``bin_numeric`` uses (for reports and tests)."""
    x = col(column).cast("double")
    if qcut:
        probs = [i / bins for i in range(bins + 1)]
        return [float(v) for v in Q.quantile_values(df, [column], probs)[column]]
    r = df.agg(F.min(x), F.max(x)).first()
    return _cut_edges(float(r[0]), float(r[1]), bins)


# ----------------------------------------------------------------- dates

# The date features, in their default (sorted) order.
DATE_FEATURES = sorted(["year", "month", "day", "weekday", "quarter", "is_weekend"])


def date_feature(ts: Column, feature: str) -> Column:
    if feature == "year":
        return F.year(ts)
    if feature == "month":
        return F.month(ts)
    if feature == "day":
        return F.dayofmonth(ts)
    if feature == "weekday":  # Monday = 0
        return F.weekday(ts)
    if feature == "quarter":
        return F.quarter(ts)
    if feature == "is_weekend":
        return F.coalesce(F.weekday(ts) >= 5, F.lit(False))
    raise OperatorError(f"Unsupported date feature '{feature}'")


def create_date_features(df: DataFrame, date_column: str, features=None, date_format: str | None = None,
                         check_parsable: bool = True) -> DataFrame:
    """DAT-1/2: parse (bad text -> NULL) and add ``{col}_{feature}`` columns.

    ``check_parsable`` runs a one-row probe and raises when no value parses.
    """
    require_columns(df, [date_column])
    feats = as_list(features) or DATE_FEATURES
    bad = [f for f in feats if f not in DATE_FEATURES]
    if bad:
        raise OperatorError(f"Unsupported date features: {', '.join(bad)}")
    dt = dtype_of(df, date_column)
    ts = col(date_column) if is_datetime(dt) else parse_timestamp(col(date_column), date_format)
    if check_parsable and not df.isStreaming:
        if df.select(ts.alias("t")).where(F.col("t").isNotNull()).limit(1).count() == 0:
            raise OperatorError(f"Failed to parse any dates in '{date_column}'")
    return df.withColumns({f"{date_column}_{f}": date_feature(ts, f) for f in feats})
