"""Grouped and whole-table aggregates, statistics and profiles (AGG-1..26).

Design rules:

* the moments and counts of every column come from **one** ``agg`` (one
  scan, partial aggregation map-side); results are reshaped to long format,
  never computed column by column;
* distinct counts and top values come from one value count per column over a
  scan of that column alone, pre-combined on the map side (no cell is
  exploded); ``approx`` uses distinct-count and heavy-hitter sketches;
* top-k per group is ``row_number() <= k``: Spark inserts a partial
  per-group limit before the shuffle, so each task ships at most k rows
  per group;
* exact quantiles come from ``operators.quantile`` (values selected from
  sketched brackets); ``approx=True`` switches to ``percentile_approx``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quantile as Q
from ..schema import (OperatorError, as_list, categorical_columns, col, datetime_columns,
                      dtype_of, family, is_numeric, numeric_columns, require_batch,
                      require_columns, require_numeric)

# Aggregate names accepted by group_by_agg.
SUPPORTED_AGGS = ["sum", "mean", "count", "min", "max", "std", "median"]
# Cardinality classes of the two profiles (upper bounds, exclusive).
PROFILE_CARDINALITY = (10, 100)
CHART_CARDINALITY = (10, 50)
# Skewness classes (absolute adjusted skewness, exclusive bounds).
SKEW_CLASSES = ((0.5, "normal"), (1.0, "moderately skewed"))
SKEW_OTHER = "highly skewed"
STRONG_CORRELATION = 0.5
QUARTILES = (0.25, 0.5, 0.75)


def _stat(fn: str, c: Column, approx: bool = False) -> Column:
    if fn == "sum":
        return F.sum(c)
    if fn == "mean":
        return F.avg(c)
    if fn == "count":
        return F.count(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn == "std":
        return F.stddev_samp(c)
    if fn == "median":
        return F.percentile_approx(c, 0.5, 10000) if approx else F.median(c)
    raise OperatorError(f"Unsupported aggregation '{fn}'")


def group_by_agg(df: DataFrame, by, agg: dict, as_index: bool = False, sort: bool = False,
                 approx: bool = False, strategy: str = "exact") -> DataFrame:
    """AGG-1..4: per column one function (keeps the name) or a list (``col_fn``).

    NULL keys are dropped, a sum over only NULLs is 0, std of one row is
    NULL.  ``as_index`` has no effect: keys are ordinary columns.
    """
    by = as_list(by)
    if not by:
        raise OperatorError("name at least one column to group by")
    if not agg:
        raise OperatorError("name at least one column to aggregate")
    require_columns(df, by, "Group-by column")
    require_columns(df, agg.keys(), "Aggregation column")
    specs = []
    for c, fns in agg.items():
        single = isinstance(fns, str)
        names = [fns] if single else list(fns)
        if not names:
            raise OperatorError(f"Invalid aggregation spec for '{c}'")
        for fn in names:
            if fn not in SUPPORTED_AGGS:
                raise OperatorError(f"Unsupported aggregation '{fn}' for '{c}'")
            if fn in ("sum", "mean", "std", "median") and not is_numeric(dtype_of(df, c)):
                raise OperatorError(f"'{fn}' needs a numeric column: {c}")
            specs.append((c, fn, c if single else f"{c}_{fn}"))
    keyed = df.filter(_all_not_null(by))
    approx = approx or strategy == "approx"
    exprs, late = [], []
    for c, fn, name in specs:
        if fn == "median" and not approx:
            late.append((c, name))  # exact medians come from value counts
            continue
        e = _stat(fn, col(c), approx)
        if fn == "sum":
            e = F.coalesce(e, F.lit(0).cast(e_type(df, c)))
        exprs.append(e.alias(name))
    if not exprs:
        exprs.append(F.count(F.lit(1)).alias("_tw_rows"))
    out = keyed.groupBy(*[col(b) for b in by]).agg(*exprs)
    if late:
        meds = Q.quantile_table(keyed, sorted({c for c, _ in late}), [0.5], by)
        wide = meds.groupBy(*[col(b) for b in by]).agg(
            *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(name) for c, name in late])
        out = out.join(wide, by, "left")
    out = out.select(*[col(b) for b in by], *[col(name) for _, _, name in specs])
    return out.orderBy(*[col(b) for b in by]) if sort else out


def e_type(df: DataFrame, c: str) -> T.DataType:
    dt = dtype_of(df, c)
    if isinstance(dt, T.IntegralType):
        return T.LongType()
    if isinstance(dt, T.DecimalType):
        return dt
    return T.DoubleType()


def _all_not_null(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & col(c).isNotNull()
    return cond


def scalar_aggs(df: DataFrame, column: str | None = None, operations=("mean", "sum", "max", "min",
                                                                      "count")) -> DataFrame:
    """AGG-11/12: scalar statistics of one column in one row, plus row count."""
    exprs = [F.count(F.lit(1)).alias("row_count")]
    if column is not None:
        require_columns(df, [column])
        for op in operations:
            if op == "count":
                exprs.append(F.count(col(column)).alias("non_null_count"))
            elif op == "median":  # exact, from value counts; one number
                exprs.append(F.lit(Q.quantile_values(df, [column], [0.5])[column][0]).cast("double").alias(op))
            else:
                exprs.append(_stat(op, col(column)).alias(op))
    return df.agg(*exprs)


# ------------------------------------------------------------- value counts

def value_counts(df: DataFrame, column: str, k: int | None = None, normalize: bool = False) -> DataFrame:
    """AGG-16: counts per value, NULL left out, descending (ties by value), top k."""
    require_columns(df, [column])
    counts = df.filter(col(column).isNotNull()).groupBy(col(column)).agg(
        F.count(F.lit(1)).alias("count"))
    if normalize:
        total = df.filter(col(column).isNotNull()).count()
        counts = counts.withColumn("percent", F.col("count") * 100.0 / F.lit(max(total, 1)))
    ordered = counts.orderBy(F.col("count").desc(), col(column).asc())
    return ordered.limit(k) if k else ordered


def group_size(df: DataFrame, by) -> DataFrame:
    """AGG-17: rows per group (NULL keys dropped)."""
    by = require_columns(df, by)
    return df.filter(_all_not_null(by)).groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("size"))


def percent_breakdown(df: DataFrame, column: str) -> DataFrame:
    """AGG-24: count and share (percent, 4 decimals) of each category.

    The total is one distributed count, passed to the plan as a literal.
    """
    require_columns(df, [column])
    kept = df.filter(col(column).isNotNull())
    total = kept.count()
    counts = kept.groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(col(column), "count",
                         F.round(F.col("count") * 100.0 / F.lit(max(total, 1)), 4).alias("percent"))


def _value(df: DataFrame, c: str) -> Column:
    """A value as it is counted: integers and booleans as long, floats as double, times without zone, else text."""
    dt = dtype_of(df, c)
    x = col(c)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return x.cast("long")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return x.cast("double") + F.lit(0.0)  # -0.0 + 0.0 = 0.0
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return x.cast("timestamp_ntz")
    return x.cast("string")


def _column_counts(df: DataFrame, c: str) -> DataFrame:
    """(value, count) of one column, NULLs left out: a scan of that column alone, combined map-side."""
    return df.select(_value(df, c).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("count"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_count_table(df: DataFrame, columns=None) -> DataFrame:
    """Long ``(column, value, count)`` over many columns, NULLs left out.

    One partially aggregated group-by per column, each over a scan of that
    column alone: no cell is exploded, and a columnar file is read once in
    all.  ``value`` is the text of the value, derived after the aggregation.
    """
    cols = require_columns(df, columns or df.columns)
    return _union([_column_counts(df, c).select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "count") for c in cols])


def distinct_table(df: DataFrame, columns) -> DataFrame:
    """(column, n) exact distinct non-null values, one row per column."""
    return _union([_column_counts(df, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), "n") for c in columns])


# Items a heavy-hitter sketch tracks per column, and candidates recounted per wanted value.
TRACKED, CANDIDATES = 4096, 10


def top_categories(df: DataFrame, columns, k: int = 10, approx: bool = False) -> DataFrame:
    """Long ``(column, rank, value, count)`` of the k most frequent values (count desc, value asc), exact.

    With ``approx`` the candidates come from one aggregate of mergeable
    heavy-hitter sketches and are recounted exactly, so no other value is
    shuffled; a column whose k-th count does not stand out over the sketch's
    error bound is counted in full.
    """
    cols = require_columns(df, columns)
    full, parts = list(cols), []
    if approx:
        wanted = CANDIDATES * k
        row = df.agg(*[e for i, c in enumerate(cols) for e in (
            F.count(col(c)).alias(f"n{i}"),
            F.call_function("approx_top_k", _value(df, c).cast("string"), F.lit(wanted), F.lit(TRACKED)).alias(f"t{i}"))]).first()
        full = []
        for i, c in enumerate(cols):
            items = [(r["item"], r["count"]) for r in row[f"t{i}"] or [] if r["item"] is not None]
            value = _value(df, c).cast("string")
            counts = df.select(value.alias("value")).filter(F.col("value").isin([v for v, _ in items])).groupBy("value").agg(
                F.count(F.lit(1)).alias("count"))
            counts = counts.orderBy(F.desc("count"), "value").limit(k)
            found = [r["count"] for r in counts.collect()] if items else []
            # what is no candidate: never tracked (at most the sketch's error), or estimated below all candidates
            bound = 4.0 * (row[f"n{i}"] or 0) / TRACKED
            if len(row[f"t{i}"] or []) >= wanted:
                bound = max(bound, min(n for _, n in items))
            sure = len(row[f"t{i}"] or []) < wanted and sum(n for _, n in items) >= row[f"n{i}"]  # every row is a candidate's
            if sure or (len(found) == k and found[-1] > bound):
                parts.append((c, counts))
            else:
                full.append(c)
    parts += [(c, _column_counts(df, c).select(F.col("value").cast("string").alias("value"), "count").orderBy(F.desc("count"), "value").limit(k)) for c in full]
    ranked = [t.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("minus"), "value"))).alias("top")).select(
        F.lit(c).alias("column"), F.posexplode("top").alias("pos", "one")) for c, t in parts]
    return _union(ranked).select("column", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.value").alias("value"), (-F.col("one.minus")).alias("count"))


def top_values(df: DataFrame, columns=None, k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Top k values of each column (count desc, value asc) with their rank."""
    vc = counts if counts is not None else value_count_table(df, columns)
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nunique(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """AGG-18: distinct non-null values per column, long format."""
    cols = require_columns(df, columns or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(col(c)).alias(f"_tw{i}") for i, c in enumerate(cols)])
        return _stack(wide, cols, "_tw", "n_unique")
    return distinct_table(df, cols).where("n > 0").select("column", F.col("n").alias("n_unique"))


def _stack(wide: DataFrame, cols: list[str], prefix: str, value_name: str) -> DataFrame:
    body = ", ".join(f"'{_sq(c)}', `{prefix}{i}`" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {body}) as (`column`, `{value_name}`)")


def _sq(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """AGG-19 / SET-4: distinct non-null values as text (sort on collect)."""
    require_columns(df, [column])
    return df.select(col(column).cast("string").alias("value")).filter(
        F.col("value").isNotNull()).distinct()


def mode_values(df: DataFrame, columns) -> dict:
    """Most frequent value per column, smallest on ties, as Python values.

    Each column is one partially aggregated group-by and a top-1 (not
    ``mode()``, whose single buffer would hold every distinct value).
    """
    cols = require_columns(df, columns)
    out = {}
    for c in cols:
        top = (df.filter(col(c).isNotNull()).groupBy(col(c)).agg(F.count(F.lit(1)).alias("_tw_n"))
               .orderBy(F.col("_tw_n").desc(), col(c).asc()).limit(1).collect())
        out[c] = top[0][0] if top else None
    return out


def mode_value(df: DataFrame, columns) -> DataFrame:
    """AGG-20: the modes as a one-row table."""
    cols = require_columns(df, columns)
    vals = mode_values(df, cols)
    return df.sparkSession.range(1).select(
        *[F.lit(vals[c]).cast(dtype_of(df, c)).alias(c) for c in cols])


def column_range(df: DataFrame, column: str) -> DataFrame:
    """AGG-25: min and max of a numeric column."""
    require_numeric(df, [column])
    return df.agg(F.min(col(column)).alias("min"), F.max(col(column)).alias("max"))


def quantiles(df: DataFrame, columns, qs=(0.25, 0.5, 0.75), approx: bool = False,
              by=None, strategy: str = "exact") -> DataFrame:
    """AGG-23: linear-interpolation quantiles, long format (by..., column, q, value).

    Exact by default; see ``operators.quantile`` for the per-column strategy.
    """
    cols = require_numeric(df, as_list(columns))
    return Q.quantile_table(df, cols, qs, by, "approx" if approx else strategy)


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted sample skewness (Spark's ``skewness`` is the population one)."""
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


# ------------------------------------------------------------------ describe

_NUM_STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def _numeric_stat_exprs(c: str, i: int) -> list[Column]:
    x = col(c).cast("double")
    return [F.count(x).alias(f"count_{i}"), F.avg(x).alias(f"mean_{i}"),
            F.stddev_samp(x).alias(f"std_{i}"), F.min(x).alias(f"min_{i}"),
            F.max(x).alias(f"max_{i}")]


def _numeric_long(wide: DataFrame, cols: list[str], keys: list[str], quart: DataFrame) -> DataFrame:
    """Moments per (group, column) joined with the quartile table (same keys)."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"count_{i}").alias("count"),
                        F.col(f"mean_{i}").alias("mean"), F.col(f"std_{i}").alias("std"),
                        F.col(f"min_{i}").alias("min"), F.col(f"max_{i}").alias("max"))
               for i, c in enumerate(cols)]
    long = wide.select(*[col(k) for k in keys], F.inline(F.array(*structs)))
    q = quart if keys else F.broadcast(quart)  # one row per column without groups
    out = long.join(q, [*keys, "column"], "left")
    return out.select(*[col(k) for k in keys], "column", "count", "mean", "std", "min",
                      "p25", "p50", "p75", "max")


def _grouped_text_describe(base: DataFrame, keys: list[str], text: list[str]) -> DataFrame:
    """count, unique, top, freq of text columns per group (AGG-6 ``include="all"``).

    Value counts per (group, column, value) are a partially aggregated
    group-by; per (group, column) the most frequent value (smallest on ties)
    is a ``max_by`` over (count, reversed value order) - no per-group sort.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
                      for c in text])
    long = base.select(*[col(k) for k in keys], F.inline(pairs)).filter(F.col("value").isNotNull())
    vc = long.groupBy(*[col(k) for k in keys], "column", "value").agg(F.count(F.lit(1)).alias("n"))
    # order: higher count first, then the smaller value (min_by over the negated count)
    best = F.min_by(F.col("value"), F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v")))
    g = vc.groupBy(*[col(k) for k in keys], "column").agg(
        F.sum("n").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("unique"),
        best.alias("top"), F.max("n").cast("long").alias("freq"))
    return g.select(*[col(k) for k in keys], "column", "count", "unique", "top", "freq",
                    *[F.lit(None).cast("double").alias(x) for x in _NUM_STATS[1:]])


def describe_stats(df: DataFrame, group_by=None, columns=None, approx: bool = False,
                   include_text: bool = True, strategy: str = "exact") -> DataFrame:
    """AGG-5/6: describe every column, one row per (group,) column.

    Numeric columns: count, mean, std, min, max (one aggregate) and
    quartiles (``operators.quantile``).
    Other columns: count, unique, top, freq from value counts (top = most
    frequent, smallest value on ties); per group as well when
    ``include_text`` (the ``include="all"`` form), else grouped describe
    covers the numeric columns only.
    """
    require_batch(df, "describe_stats")
    keys = as_list(group_by)
    require_columns(df, keys)
    cols = require_columns(df, columns) if columns else [c for c in df.columns if c not in keys]
    num = [c for c in cols if is_numeric(dtype_of(df, c))]
    text = [c for c in cols if c not in num]
    base = df.filter(_all_not_null(keys)) if keys else df
    aggs = [e for i, c in enumerate(num) for e in _numeric_stat_exprs(c, i)]
    strat = "approx" if approx else strategy
    if keys:
        if not num and not include_text:
            raise OperatorError("grouped describe needs numeric columns")
        parts = []
        if num:
            wide = base.groupBy(*[col(k) for k in keys]).agg(*aggs)
            quart = Q.quantile_wide(base, num, QUARTILES, ["p25", "p50", "p75"], keys, strat)
            nl = _numeric_long(wide, num, keys, quart)
            if not (include_text and text):
                return nl
            parts.append(nl.select(*[col(k) for k in keys], "column", "count",
                                   F.lit(None).cast("long").alias("unique"),
                                   F.lit(None).cast("string").alias("top"),
                                   F.lit(None).cast("long").alias("freq"),
                                   *[F.col(x) for x in _NUM_STATS[1:]]))
        parts.append(_grouped_text_describe(base, keys, text))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    # whole table: one aggregate for the moments and distinct estimates of the
    # numeric columns and the non-null counts of the others (one row back)
    aggs = [e for i, c in enumerate(num) for e in _numeric_stat_exprs(c, i)]
    aggs += [F.count(col(c)).alias(f"tn_{i}") for i, c in enumerate(text)]
    row = base.agg(*aggs).first() if aggs else None
    parts = []
    if num:
        quart = Q.quantile_wide(base, num, QUARTILES, ["p25", "p50", "p75"], None, strat)
        facts = base.sparkSession.createDataFrame(
            [(c, row[f"count_{i}"], row[f"mean_{i}"], row[f"std_{i}"], row[f"min_{i}"], row[f"max_{i}"])
             for i, c in enumerate(num)],
            "column string, count long, mean double, std double, min double, max double")
        nl = facts.join(F.broadcast(quart), "column", "left")  # one row per column each
        parts.append(nl.select("column", "count",
                               F.lit(None).cast("long").alias("unique"),
                               F.lit(None).cast("string").alias("top"),
                               F.lit(None).cast("long").alias("freq"),
                               *[F.col(s) for s in _NUM_STATS[1:]]))
    if text and include_text:
        nn = base.sparkSession.createDataFrame([(c, row[f"tn_{i}"]) for i, c in enumerate(text)],
                                               "column string, count long")
        vc = value_count_table(base, text)
        uniq = vc.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"), F.max("count").alias("freq"))
        # uniq has one row per column: broadcast it, never shuffle vc by column
        tops = vc.join(F.broadcast(uniq.select("column", F.col("freq").alias("_tw_f"))), "column").filter(
            F.col("count") == F.col("_tw_f")).groupBy("column").agg(F.min("value").alias("top"))
        tl = nn.join(F.broadcast(uniq), "column", "left").join(F.broadcast(tops), "column", "left")
        parts.append(tl.select("column", F.col("count").cast("long").alias("count"),
                               F.coalesce(F.col("unique"), F.lit(0)).cast("long").alias("unique"),
                               "top", F.col("freq").cast("long").alias("freq"),
                               *[F.lit(None).cast("double").alias(s) for s in _NUM_STATS[1:]]))
    if not parts:
        raise OperatorError("nothing to describe")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------- profiles

def _cardinality(n: Column, bounds) -> Column:
    low, mid = bounds
    return F.when(n < low, "low").when(n < mid, "medium").otherwise("high")


def column_profile(df: DataFrame, columns=None, approx: bool = False,
                   cardinality=PROFILE_CARDINALITY, with_skew: bool = False,
                   strategy: str = "exact", top_k: int = 0) -> DataFrame:
    """AGG-9 (and AGG-10 with ``with_skew`` and chart cardinality classes).

    One row per column: dtype, kind, distinct and NULL counts, missing
    percent (2 decimals), cardinality class; numeric columns also mean,
    median, std (0 with fewer than two values), min, max, q25, q75.  With
    ``top_k`` categorical columns get ``top`` (array of value, count: the most
    frequent first) and, with ``with_skew``, numeric ones ``strong`` (array of
    column, r: later columns with abs(r) over ``STRONG_CORRELATION``, column order,
    ten pairs in all).

    One aggregate gives counts, moments and (``approx``) distinct-count
    sketches of every column, one row to the driver, a second one the sums of
    products behind the correlations; exact
    distinct counts scan each column alone; quartiles are selected from
    sketched brackets (see ``quantile``); no cell is exploded.
    """
    require_batch(df, "column_profile")
    cols = require_columns(df, columns or df.columns)
    num = [c for c in cols if is_numeric(dtype_of(df, c))]
    strat = "approx" if approx else strategy
    aggs = [F.count(F.lit(1)).alias("_tw_n")] + [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    if approx:
        aggs += [F.approx_count_distinct(_value(df, c)).alias(f"d{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(num):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        if with_skew:
            aggs.append(adjusted_skewness(x).alias(f"skew{i}"))
    row = df.agg(*aggs).first()
    n = row["_tw_n"]
    distinct = {c: row[f"d{i}"] for i, c in enumerate(cols)} if approx else {
        r["column"]: r["n"] for r in distinct_table(df, cols).collect()}
    quart = Q.quantile_values(df, num, QUARTILES, strat) if num else {}
    strong = []
    if with_skew and top_k and len(num) > 1:
        facts = {c: (row[f"mean{i}"], row[f"std{i}"], row[f"n{cols.index(c)}"]) for i, c in enumerate(num)}
        strong = [x for x in _pair_correlations(df, num, facts, n) if x[2] is not None and abs(x[2]) > STRONG_CORRELATION][:10]
    cats = [c for c in cols if c not in num and family(dtype_of(df, c)) != "datetime"]
    top: dict[str, list] = {}
    if top_k and cats:
        for r in sorted(top_categories(df, cats, top_k, approx).collect(), key=lambda r: r["rank"]):
            top.setdefault(r["column"], []).append((r["value"], r["count"]))
    facts = []
    for i, c in enumerate(cols):
        dt = dtype_of(df, c)
        kind = "numeric" if c in num else ("datetime" if family(dt) == "datetime" else "categorical")
        j = num.index(c) if c in num else None
        nulls = n - row[f"n{i}"]
        facts.append((c, dt.simpleString(), kind, i, distinct.get(c) or 0, nulls,
                      round(nulls * 100.0 / n, 2) if n else None,
                      *([row[f"mean{j}"], quart[c][1], row[f"std{j}"], row[f"min{j}"], row[f"max{j}"], quart[c][0], quart[c][2]]
                        if j is not None else [None] * 7),
                      *([row[f"skew{j}"] if j is not None else None] if with_skew else []),
                      *([top.get(c)] if top_k else []),
                      *([[(b, r) for a, b, r in strong if a == c] or None] if top_k and with_skew else [])))
    schema = ("column string, dtype string, kind string, ordinal int, n_distinct long, n_null long, missing_pct double, "
              "mean double, median double, std double, min double, max double, q25 double, q75 double" + (", skewness double" if with_skew else "")
              + (", top array<struct<value:string,count:bigint>>" if top_k else "")
              + (", strong array<struct<column:string,r:double>>" if top_k and with_skew else ""))
    prof = df.sparkSession.createDataFrame(facts, schema)
    prof = prof.select("column", "dtype", "kind", "ordinal", "n_distinct", "n_null", "missing_pct",
                       _cardinality(F.col("n_distinct"), cardinality).alias("cardinality"),
                       "mean", "median", "std", "min", "max", "q25", "q75", *prof.columns[14:])
    if with_skew:
        sk = F.abs(F.col("skewness"))
        (b1, l1), (b2, l2) = SKEW_CLASSES
        prof = prof.withColumn("skew_class", F.when(F.col("skewness").isNull(), F.lit(None))
                               .when(sk < b1, l1).when(sk < b2, l2).otherwise(SKEW_OTHER))
    return prof


def _stack_with_total(counts: DataFrame, cols: list[str]) -> DataFrame:
    body = ", ".join(f"'{_sq(c)}', `_tw{i}`" for i, c in enumerate(cols))
    return counts.selectExpr("_tw_n", f"stack({len(cols)}, {body}) as (`column`, non_null)")


def chart_stats(df: DataFrame, columns=None, approx: bool = False, top_k: int = 0) -> DataFrame:
    """AGG-10: the chart-oriented profile (cardinality <10 / <50, skewness class; with ``top_k``
    the top values and strong pairs)."""
    return column_profile(df, columns, approx, CHART_CARDINALITY, with_skew=True, top_k=top_k)


# -------------------------------------------------------------- correlation

def _pair_corr(x: str, y: str) -> Column:
    """Pearson r on pairwise-complete rows; NULL for a constant column (``corr`` divides by its zero)."""
    cx, cy = col(x).cast("double"), col(y).cast("double")
    spread = F.sqrt(F.regr_sxx(cy, cx)) * F.sqrt(F.regr_syy(cy, cx))
    return F.try_divide(F.regr_sxy(cy, cx), F.nullif(spread, F.lit(0.0)))


def _pair_correlations(df: DataFrame, num: list[str], facts: dict, n: int) -> list[tuple[str, str, float | None]]:
    """(x, y, r) of all pairs in column order, given (mean, std, non-null count) of each column: one
    sum of products of centred values a pair, the general form where a column has NULLs."""
    pairs = [(a, b) for i, a in enumerate(num) for b in num[i + 1:]]
    whole = {c for c in num if facts[c][2] == n}

    def centred(c):
        return col(c).cast("double") - F.lit(facts[c][0])

    row = df.agg(*[(F.sum(centred(a) * centred(b)) if a in whole and b in whole else _pair_corr(a, b)).alias(f"r{k}")
                   for k, (a, b) in enumerate(pairs)]).first()
    out = []
    for k, (a, b) in enumerate(pairs):
        r = row[f"r{k}"]
        if a in whole and b in whole:
            spread = (n - 1) * (facts[a][1] or 0.0) * (facts[b][1] or 0.0)
            r = r / spread if r is not None and spread else None
        out.append((a, b, r))
    return out


def corr_matrix(df: DataFrame, columns=None, include_diagonal: bool = True) -> DataFrame:
    """AGG-13: all numeric pairs, long ``(col_x, col_y, r)``.

    Two aggregates (moments, then sums of products), one row each; each
    unordered pair is computed once and emitted in both orders.
    """
    cols = require_numeric(df, columns) if columns else numeric_columns(df)
    if len(cols) < 2:
        raise OperatorError("correlation needs at least two numeric columns")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(cols) for e in (
        F.avg(col(c).cast("double")).alias(f"m{i}"), F.stddev_samp(col(c).cast("double")).alias(f"s{i}"), F.count(col(c)).alias(f"n{i}"))]).first()
    facts = {c: (row[f"m{i}"], row[f"s{i}"], row[f"n{i}"]) for i, c in enumerate(cols)}
    out = [(c, c, 1.0 if facts[c][1] else None) for c in cols] if include_diagonal else []
    for a, b, r in _pair_correlations(df, cols, facts, row["n"]):
        out += [(a, b, r), (b, a, r)]
    return df.sparkSession.createDataFrame(out, "col_x string, col_y string, r double")


def corr_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """AGG-14: correlation of two columns."""
    require_numeric(df, [x, y])
    return df.agg(_pair_corr(x, y).alias("r"))


def corr_with_target(df: DataFrame, target: str, columns=None) -> DataFrame:
    """AGG-14: correlation of every numeric column with a target, long format."""
    require_numeric(df, [target])
    cols = [c for c in (require_numeric(df, columns) if columns else numeric_columns(df))
            if c != target]
    wide = df.agg(*[_pair_corr(c, target).alias(f"_tw{i}") for i, c in enumerate(cols)])
    return _stack(wide, cols, "_tw", "r")


def strong_correlations(df: DataFrame, columns=None, threshold: float = STRONG_CORRELATION,
                        k: int = 10) -> DataFrame:
    """AGG-10 part: pairs with abs(r) above the threshold, strongest k first."""
    pairs = corr_matrix(df, columns, include_diagonal=False).filter(F.col("col_x") < F.col("col_y"))
    strong = pairs.filter(F.abs(F.col("r")) > threshold)
    return strong.orderBy(F.abs(F.col("r")).desc(), "col_x", "col_y").limit(k)


def category_relation(df: DataFrame, category: str, value: str) -> DataFrame:
    """AGG-15: mean and count of a number per category."""
    require_columns(df, [category])
    require_numeric(df, [value])
    return df.filter(col(category).isNotNull()).groupBy(col(category)).agg(
        F.avg(col(value)).alias("mean"), F.count(col(value)).alias("count"))


def best_group(df: DataFrame, by: str, value: str, worst: bool = False, fn: str = "mean") -> DataFrame:
    """AGG-21: the group with the highest (lowest) aggregate; ties by key."""
    g = group_by_agg(df, [by], {value: fn})
    g = g.filter(col(value).isNotNull())
    order = col(value).asc() if worst else col(value).desc()
    return g.orderBy(order, col(by).asc()).limit(1)


def having_filter(df: DataFrame, by, agg: dict, condition) -> DataFrame:
    """AGG-22: group aggregate, then a predicate on the aggregated columns."""
    from .selection import filter_rows
    return filter_rows(group_by_agg(df, by, agg), condition)


# ------------------------------------------------------------------ summary

def schema_listing(df: DataFrame) -> DataFrame:
    """AGG-26: one row per column: position, name, type, family (no job)."""
    rows = [(i, f.name, f.dataType.simpleString(), family(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, dtype string, family string")


def table_summary(df: DataFrame) -> dict:
    """AGG-8: rows, columns, dtypes, missing counts/percent, column lists, numeric describe.

    Returns a dict of small DataFrames plus scalars (a row count, one
    aggregate for the missing counts, the numeric describe).
    """
    from .cleaning import missing_counts
    require_batch(df, "table_summary")
    missing = missing_counts(df)
    n_rows = df.count()
    return {
        "rows": n_rows,
        "columns": len(df.columns),
        "dtypes": schema_listing(df),
        "missing": missing,
        "numeric_columns": numeric_columns(df),
        "categorical_columns": categorical_columns(df),
        "datetime_columns": datetime_columns(df),
        "describe": describe_stats(df, columns=numeric_columns(df)) if numeric_columns(df) else None,
    }


def summary_row(df: DataFrame) -> DataFrame:
    """AGG-8 as one row: rows, column counts by family, missing cells (one scan)."""
    cols = df.columns
    missing = [F.count_if(col(c).isNull()).alias(f"_tw{i}") for i, c in enumerate(cols)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *missing)
    total = sum((F.col(f"_tw{i}") for i in range(len(cols))), F.lit(0))
    with_missing = sum((F.when(F.col(f"_tw{i}") > 0, 1).otherwise(0) for i in range(len(cols))), F.lit(0))
    return wide.select(
        "rows", F.lit(len(cols)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).alias("datetime_columns"),
        total.cast("long").alias("total_missing"),
        F.round(F.try_divide(total * 100.0, F.col("rows") * len(cols)), 2).alias("missing_pct"),
        with_missing.cast("int").alias("columns_with_missing"))


def schema_counts(df: DataFrame) -> DataFrame:
    """AGG-26: schema listing with the non-null count of every column."""
    meta = schema_listing(df)
    counts = df.agg(*[F.count(col(c)).alias(f"_tw{i}") for i, c in enumerate(df.columns)])
    long = _stack(counts, df.columns, "_tw", "non_null")
    return F.broadcast(meta).join(long, "column")


def _nan_safe(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v
