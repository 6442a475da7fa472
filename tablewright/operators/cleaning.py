"""Cleaning: de-duplication, missing values, fills, replacement, strings, outliers.

FLT-6..9, WIN-1..6, FIL-1..3, REP-1..5, STR-6, OUT-1..5.

Data-dependent parameters (means, quartiles, bounds) come from small
aggregates over all requested columns (quartiles via ``operators.quantile``);
their values are returned to the driver and used as literals, so the final
plan is a plain filter or projection that Catalyst can push into the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import STRING_OPERATIONS, java_replacement, literal_pattern, replace_text
from ..order import PID, POS, Positions, carry, follow, keep_positions, order_key, positioned
from ..schema import (OperatorError, as_list, col, dtype_of, is_numeric, is_string, normalize_nan,
                      numeric_columns, require_batch, require_columns, require_numeric,
                      require_string)
from .selection import predicate

# --------------------------------------------------------------- row removal


def drop_rows(df: DataFrame, condition=None, indices=None, subset=None, keep="first",
              order_by=None, variables: dict | None = None) -> DataFrame:
    """FLT-6 (condition), FLT-7 (positions), WIN-4/5 (duplicates)."""
    given = [x is not None for x in (condition, indices, subset)]
    if sum(given) != 1:
        raise OperatorError("Give exactly one of condition, indices or subset")
    if condition is not None:
        pred = predicate(condition, variables)
        # rows whose test is NULL stay, as with a negated mask
        out = df.filter(~F.coalesce(pred, F.lit(False)))
        out.schema
        return out
    if indices is not None:
        return drop_positions(df, indices, order_by)
    return drop_duplicates(df, subset, keep, order_by)


def drop_positions(df: DataFrame, indices, order_by) -> DataFrame:
    """FLT-7: delete rows by position in ``order_by`` order; negatives count from the end.

    Rows get exact distributed positions; out-of-range positions raise.
    """
    require_batch(df, "drop_rows(indices)")
    idx = [int(i) for i in as_list(indices)]
    if not idx:
        return df
    known = positioned(df, order_by)
    n = F.lit(known.total)
    lo, hi = min(idx), max(idx)
    check = F.when((F.lit(hi) >= n) | (F.lit(lo) < -n),
                   F.raise_error(F.lit(f"row positions out of range: {idx}")))
    gone = sorted({i + known.total if i < 0 else i for i in idx})
    kept = F.coalesce(check.cast("boolean"), F.lit(True)) & ~F.col(POS).isin(gone)
    keep = [col(c) for c in df.columns]

    def rows(a: int, b: int) -> DataFrame:
        part = known.rows(a, b + len(gone)).filter(kept)
        before = F.size(F.filter(F.array(*[F.lit(i).cast("long") for i in gone]), lambda i: i < F.col(POS)))
        return part.select(*keep, (F.col(POS) - before).alias(POS), PID)

    out = known.rows(0, known.total).filter(kept).select(*keep)
    return keep_positions(out, Positions(known.key, rows, known.total - len(gone)))


def drop_duplicates(df: DataFrame, subset=None, keep="first", order_by=None) -> DataFrame:
    """WIN-4/5: one aggregate per key, so a hot key is pre-combined map-side.

    ``keep='first'/'last'`` keeps the row with the smallest/largest
    ``order_by`` value (``min_by``/``max_by`` over a struct, partial
    aggregation); ``keep=False`` keeps keys that occur once.  NULL keys
    equal each other, as in grouping.
    """
    subset = require_columns(df, subset or df.columns)
    others = [c for c in df.columns if c not in subset]
    keys = [col(c) for c in subset]
    if keep is False or keep == "none":
        row = F.struct(*[col(c) for c in others]) if others else F.lit(None)
        agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tw_cnt"),
                                    F.any_value(row).alias("_tw_row"))
        out = agg.filter(F.col("_tw_cnt") == 1)
        return out.select(*[F.col("_tw_row").getField(c).alias(c) if c in others else col(c)
                            for c in df.columns])
    if keep not in ("first", "last"):
        raise OperatorError("keep must be 'first', 'last' or False")
    if not others:
        return df.select(*keys).distinct()
    if order_by is None:
        raise OperatorError("keep='first'/'last' needs order_by (tables have no row order)")
    ord_cols = as_list(order_by)
    require_columns(df, ord_cols)
    order_key = F.struct(*[col(c) for c in ord_cols])
    row = F.struct(*[col(c) for c in others])
    pick = F.min_by(row, order_key) if keep == "first" else F.max_by(row, order_key)
    agg = df.groupBy(*keys).agg(pick.alias("_tw_row"))
    return agg.select(*[F.col("_tw_row").getField(c).alias(c) if c in others else col(c)
                        for c in df.columns])


def duplicate_stats(df: DataFrame, subset=None, keep="first") -> DataFrame:
    """WIN-6: original, unique and dropped row counts in one pass."""
    subset = require_columns(df, subset or df.columns)
    per_key = df.groupBy(*[col(c) for c in subset]).agg(F.count(F.lit(1)).alias("_tw_cnt"))
    kept = (F.sum(F.when(F.col("_tw_cnt") == 1, 1).otherwise(0)) if keep is False
            else F.count(F.lit(1)))
    return per_key.agg(F.sum("_tw_cnt").cast("long").alias("original_rows"),
                       F.count(F.lit(1)).alias("unique_keys"),
                       kept.cast("long").alias("kept_rows")).select(
        "original_rows", "unique_keys", "kept_rows",
        (F.col("original_rows") - F.col("kept_rows")).alias("dropped_rows"))


def drop_missing(df: DataFrame, how: str = "any", thresh: int | None = None, axis: int = 0,
                 subset=None) -> DataFrame:
    """FLT-8 rows (``axis=0``) / FLT-9 columns (``axis=1``) with missing values."""
    if how not in ("any", "all"):
        raise OperatorError("how must be 'any' or 'all'")
    if axis == 0:
        cols = require_columns(df, subset) if subset else None
        if thresh is not None:
            return df.na.drop(thresh=thresh, subset=cols)
        return df.na.drop(how=how, subset=cols)
    if axis != 1:
        raise OperatorError("axis must be 0 or 1")
    require_batch(df, "drop_missing(axis=1)")
    rows = df.filter(predicate(subset)) if isinstance(subset, str) else df
    counts = rows.agg(F.count(F.lit(1)).alias("_tw_n"),
                      *[F.count(col(c)).alias(c) for c in df.columns]).first().asDict()
    n = counts.pop("_tw_n")
    if thresh is not None:
        drop = [c for c, k in counts.items() if k < thresh]
    elif how == "any":
        drop = [c for c, k in counts.items() if k < n]
    else:
        drop = [c for c, k in counts.items() if k == 0]
    return df.drop(*drop)


# ---------------------------------------------------------------------- fills

FILL_METHODS = {"mean", "median", "mode", "ffill", "bfill", "interpolate"}


def _fill_stats(df: DataFrame, plan: dict[str, str]) -> dict:
    """Fill values: means from one aggregate, exact medians, modes by value counts."""
    from . import aggregate as A
    from . import quantile as Q
    out = {}
    means = [c for c, m in plan.items() if m == "mean"]
    if means:
        out.update(df.agg(*[F.avg(col(c)).alias(c) for c in means]).first().asDict())
    medians = [c for c, m in plan.items() if m == "median"]
    if medians:
        out.update({c: v[0] for c, v in Q.quantile_values(df, medians, [0.5]).items()})
    modes = [c for c, m in plan.items() if m == "mode"]
    if modes:
        out.update(A.mode_values(df, modes))
    return out


def fill_missing(df: DataFrame, value=None, method: str | None = None, values: dict | None = None,
                 methods: dict | None = None, interpolate_method: str | None = None,
                 columns=None, order_by=None, strict: bool = False) -> DataFrame:
    """FIL-1/2, WIN-1..3: constants, statistics or order-based fills.

    A value, per column or global, wins over any method, and then a
    column's own setting over the global one.  NaN counts as missing.  ``strict`` raises when a listed column has no setting (the
    reference raises when such a column holds nulls).  Order-based fills
    need ``order_by`` (a total order).
    """
    values, methods = dict(values or {}), dict(methods or {})
    targets = require_columns(df, columns) if columns else list(df.columns)
    require_columns(df, list(values) + list(methods))
    const: dict[str, object] = {}
    plan: dict[str, str] = {}
    for c in targets:
        if c in values:
            const[c] = values[c]
        elif value is not None:
            const[c] = value
        elif c in methods:
            plan[c] = methods[c]
        elif method is not None:
            plan[c] = method
        elif strict:
            raise OperatorError(f"No fill value or method for column '{c}'")
    for c, m in plan.items():
        if m not in FILL_METHODS:
            raise OperatorError(f"Unknown fill method '{m}'")
        if m in ("mean", "median", "interpolate") and not is_numeric(dtype_of(df, c)):
            raise OperatorError(f"Method '{m}' needs a numeric column: {c}")
    if "interpolate" in plan.values() and interpolate_method not in (None, "linear"):
        raise OperatorError("only linear interpolation is supported")
    df = out = follow(df, lambda t: normalize_nan(t, targets), targets)
    stats = _fill_stats(df, {c: m for c, m in plan.items() if m in ("mean", "median", "mode")})
    exprs = {}
    for c, v in const.items():
        exprs[c] = F.coalesce(col(c), F.lit(v).cast(dtype_of(df, c)))
    for c, v in stats.items():
        if v is not None:
            exprs[c] = F.coalesce(col(c), F.lit(v).cast(dtype_of(df, c)))
    if exprs:
        out = follow(out, lambda t: t.withColumns(exprs), exprs)
    ordered = {c: m for c, m in plan.items() if m in ("ffill", "bfill", "interpolate")}
    if ordered:
        if order_by is None:
            raise OperatorError("ffill / bfill / interpolate need order_by")
        out = _ordered_fill(out, ordered, order_by)
    return out


def _ordered_fill(df: DataFrame, plan: dict[str, str], order_by) -> DataFrame:
    """ffill / bfill / linear interpolation: one positioned table and the two-phase carry."""
    require_batch(df, "ordered fill")
    known = positioned(df, order_by) if order_key(order_by) else None
    df = keep_positions(df, known)
    fwd, bwd = {}, {}
    number = {c: i for i, c in enumerate(plan)}
    for c, m in plan.items():
        if m == "ffill":
            fwd[f"_tw_f_{number[c]}"] = col(c)
        elif m == "bfill":
            bwd[f"_tw_b_{number[c]}"] = col(c)
        else:  # linear: previous and next (position, value)
            pair = F.when(col(c).isNotNull(), F.struct(F.col(POS).alias("p"),
                                                       col(c).cast("double").alias("v")))
            fwd[f"_tw_f_{number[c]}"] = pair
            bwd[f"_tw_b_{number[c]}"] = pair
    cur = carry(df, order_by, fwd, bwd, keep_partition=True)
    exprs = {}
    for c, m in plan.items():
        if m == "ffill":
            exprs[c] = F.coalesce(col(c), F.col(f"_tw_f_{number[c]}"))
        elif m == "bfill":
            exprs[c] = F.coalesce(col(c), F.col(f"_tw_b_{number[c]}"))
        else:
            prev, nxt = F.col(f"_tw_f_{number[c]}"), F.col(f"_tw_b_{number[c]}")
            frac = (F.col(POS) - prev["p"]) / (nxt["p"] - prev["p"])
            line = prev["v"] + (nxt["v"] - prev["v"]) * frac
            # leading NULLs stay NULL, trailing NULLs take the last value
            filled = F.when(prev.isNull(), F.lit(None)).when(nxt.isNull(), prev["v"]).otherwise(line)
            exprs[c] = F.coalesce(col(c).cast("double"), filled).cast(
                dtype_of(df, c) if not isinstance(dtype_of(df, c), T.IntegralType) else "double")
    filled, keep = cur.withColumns(exprs), [col(c) for c in df.columns]
    out = filled.select(*keep)
    if known is not None and not known.columns() & set(plan):
        keep_positions(out, Positions(known.key, lambda lo, hi: filled.select(*keep, POS, PID), known.total))
    return out


def fill_report(before: DataFrame, after: DataFrame, columns=None) -> DataFrame:
    """FIL-3: NULLs per column before and after, filled count; long format."""
    cols = require_columns(before, columns or before.columns)
    b = before.agg(*[F.count_if(col(c).isNull()).alias(c) for c in cols]).first()
    a = after.agg(*[F.count_if(col(c).isNull()).alias(c) for c in cols]).first()
    rows = [(c, int(b[c]), int(a[c]), int(b[c]) - int(a[c])) for c in cols]
    return before.sparkSession.createDataFrame(
        rows, "column string, missing_before long, missing_after long, filled long")


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    """AGG-7: missing count and percent per column, long format, one scan."""
    cols = require_columns(df, columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_tw_n"),
                  *[F.count_if(col(c).isNull()).alias(f"_tw_m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', `_tw_m{i}`" for i, c in enumerate(cols))
    long = wide.selectExpr("_tw_n", f"stack({len(cols)}, {stack}) as (`column`, missing_count)")
    return long.select(
        "column", F.col("missing_count").cast("long").alias("missing_count"),
        F.round(F.try_divide(F.col("missing_count") * 100.0, F.col("_tw_n")), 2)
        .alias("missing_pct"))


# ---------------------------------------------------------------- replacement

def _key_fits(value, dt: T.DataType) -> bool:
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(dt, T.BooleanType)
    if isinstance(value, (int, float)):
        return is_numeric(dt)
    if isinstance(value, str):
        return is_string(dt)
    return False


def replace_values(df: DataFrame, to_replace: dict, value=None, regex: bool = False,
                   case_insensitive: bool = False) -> DataFrame:
    """REP-1..4: per-column {old: new} maps applied all at once (no chaining).

    Keys whose type does not fit the column leave it unchanged.  ``regex``
    and ``case_insensitive`` replace matches inside strings; ``value`` maps
    every key to one value.
    """
    if not to_replace:
        raise OperatorError("give at least one column to replace in")
    if any(k is None for m in to_replace.values() for k in m):
        raise OperatorError("a missing value is filled with fill_missing, not replaced")
    require_columns(df, to_replace.keys())
    exprs = {}
    for c, mapping in to_replace.items():
        dt = dtype_of(df, c)
        if isinstance(mapping, (list, tuple, set)):
            if value is None:
                raise OperatorError("a list of keys needs value=")
            mapping = {k: value for k in mapping}
        elif value is not None:
            mapping = {k: value for k in mapping}
        cur = col(c)
        if regex or case_insensitive:
            if not is_string(dt):
                continue
            for old, new in mapping.items():
                pat = old if regex else literal_pattern(str(old), True)
                if regex and case_insensitive:
                    pat = "(?i)" + pat
                repl = java_replacement(str(new)) if regex else str(new).replace("\\", "\\\\").replace("$", "\\$")
                cur = F.regexp_replace(cur, pat, repl)
            exprs[c] = cur
            continue
        fits = {k: v for k, v in mapping.items() if _key_fits(k, dt)}
        if not fits:
            continue
        if not all(_key_fits(v, dt) for v in fits.values()):
            if not all(isinstance(v, str) for v in fits.values()):
                raise OperatorError(f"the new values for '{c}' are of several types")
            cur_out = cur.cast("string")  # numbers replaced by text: the column becomes text
        else:
            cur_out = cur
        expr = None
        for old, new in fits.items():
            new_lit = F.lit(new)
            expr = (F.when(cur == F.lit(old), new_lit) if expr is None
                    else expr.when(cur == F.lit(old), new_lit))
        exprs[c] = expr.otherwise(cur_out)
    return df.withColumns(exprs) if exprs else df


def change_counts(before: DataFrame, after: DataFrame, columns, key) -> DataFrame:
    """REP-5 / STR-6 report: cells changed per column, joined on a row key."""
    cols = as_list(columns)
    keys = as_list(key)
    a = after.select(*[col(k) for k in keys], *[col(c).alias(f"_tw_a_{c}") for c in cols])
    j = before.join(a, keys)
    return j.agg(*[F.count_if(~col(c).eqNullSafe(F.col(f"_tw_a_{c}"))).alias(c) for c in cols])


def clean_strings(df: DataFrame, columns, operation: str = "strip", operations=None,
                  pattern: str | None = None, replacement: str = "",
                  case_insensitive: bool = False, replace_regex: bool = True) -> DataFrame:
    """STR-6: a chain of string operations, in the given order."""
    cols = require_string(df, as_list(columns))
    ops = as_list(operations) or [operation]
    for op in ops:
        if op != "replace" and op not in STRING_OPERATIONS:
            raise OperatorError(f"Unknown string operation '{op}'")
        if op == "replace" and pattern is None:
            raise OperatorError("replace needs a pattern")
    exprs = {}
    for c in cols:
        cur = col(c)
        for op in ops:
            if op == "replace":
                cur = replace_text(cur, pattern, replacement, replace_regex, case_insensitive)
            else:
                cur = STRING_OPERATIONS[op](cur)
        exprs[c] = cur
    return df.withColumns(exprs)


# ------------------------------------------------------------------- outliers

def outlier_bounds(df: DataFrame, columns, method: str = "iqr", threshold: float = 1.5,
                   approx: bool = False, strategy: str = "exact") -> dict[str, dict]:
    """OUT-1/2/5: bounds of every column (exact quartiles, or mean and std)."""
    from . import quantile as Q
    cols = require_numeric(df, as_list(columns))
    if method not in ("iqr", "zscore"):
        raise OperatorError("method must be 'iqr' or 'zscore'")
    out = {}
    if method == "iqr":
        qv = Q.quantile_values(df, cols, [0.25, 0.75], "approx" if approx else strategy)
        for c in cols:
            q1, q3 = qv[c]
            if q1 is None:
                out[c] = {"lower": None, "upper": None, "q1": None, "q3": None}
                continue
            iqr = q3 - q1
            out[c] = {"lower": q1 - threshold * iqr, "upper": q3 + threshold * iqr, "q1": q1, "q3": q3}
        return out
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if s is None or s == 0:
            out[c] = {"lower": None, "upper": None, "mean": m, "std": s}
        else:
            out[c] = {"lower": m - threshold * s, "upper": m + threshold * s, "mean": m, "std": s}
    return out


def _is_outlier(c: str, b: dict) -> Column | None:
    if b["lower"] is None:
        return None
    x = col(c)
    return (x < F.lit(b["lower"])) | (x > F.lit(b["upper"]))


def remove_outliers(df: DataFrame, columns, method: str = "iqr", threshold: float = 1.5,
                    handle_method: str = "remove", approx: bool = False) -> DataFrame:
    """OUT-3/4: drop rows that are outliers in any column, or clamp to the bounds.

    Strict comparisons; NULL is never an outlier.  With ``zscore`` the
    bounds are mean +- threshold * sample std (none when std is 0).
    """
    require_batch(df, "remove_outliers")
    if handle_method not in ("remove", "cap", "winsorize"):
        raise OperatorError("handle_method must be 'remove', 'cap' or 'winsorize'")
    bounds = outlier_bounds(df, columns, method, threshold, approx)
    if handle_method == "remove":
        # keep = NULL or inside the bounds, for every column (a form the Parquet
        # reader can apply: row groups outside the bounds are skipped)
        keeps = [col(c).isNull() | col(c).between(F.lit(b["lower"]), F.lit(b["upper"]))
                 for c, b in bounds.items() if b["lower"] is not None]
        if not keeps:
            return df
        return df.filter(reduce(lambda x, y: x & y, keeps))
    exprs = {}
    for c, b in bounds.items():
        if b["lower"] is None:
            continue
        dt = dtype_of(df, c)
        exprs[c] = clamp(col(c), b["lower"], b["upper"]).cast(
            "double" if isinstance(dt, T.IntegralType) else dt)
    return df.withColumns(exprs) if exprs else df


def clamp(x: Column, lower: float, upper: float) -> Column:
    """OUT-4: clamp to [lower, upper]; NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    lo, hi = F.lit(lower), F.lit(upper)
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def outlier_report(df: DataFrame, columns, method: str = "iqr", threshold: float = 1.5,
                   approx: bool = False) -> DataFrame:
    """OUT-5: one row per column: bounds and outlier counts (one more scan)."""
    bounds = outlier_bounds(df, columns, method, threshold, approx)
    aggs = []
    for i, (c, b) in enumerate(bounds.items()):
        t = _is_outlier(c, b)
        aggs += [F.count_if(t).alias(f"o{i}") if t is not None else F.lit(0).alias(f"o{i}"),
                 F.count_if(col(c) < F.lit(b["lower"])).alias(f"l{i}") if t is not None
                 else F.lit(0).alias(f"l{i}"),
                 F.count_if(col(c) > F.lit(b["upper"])).alias(f"h{i}") if t is not None
                 else F.lit(0).alias(f"h{i}")]
    counts = df.agg(*aggs).first()
    rows = []
    for i, (c, b) in enumerate(bounds.items()):
        rows.append((c, b["lower"], b["upper"], int(counts[f"o{i}"]), int(counts[f"l{i}"]),
                     int(counts[f"h{i}"])))
    return df.sparkSession.createDataFrame(
        rows, "column string, lower double, upper double, outliers long, below long, above long")


def numeric_or_all(df: DataFrame, columns=None) -> list[str]:
    return require_columns(df, columns) if columns else numeric_columns(df)
