"""Data behind charts, and rule-based chart checks (CHD-1..11, CHK-1..3).

Only the aggregation that feeds a chart is built; drawing is out of scope.
All charts aggregate the full table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import (OperatorError, as_list, col, dtype_of, family, is_numeric, numeric_columns,
                      require_batch, require_columns, require_numeric)
from . import quantile as Q
from ..order import freeze
from .aggregate import CHART_CARDINALITY, _stat, category_relation, corr_matrix, group_by_agg, nunique, value_counts
from .selection import sample_rows

# Chart kinds, aggregate names and limits of the chart layer.
CHART_TYPES = ["bar", "line", "area", "pie", "histogram", "box", "scatter", "heatmap", "combo"]
CHART_AGGS = ["count", "sum", "mean", "median", "min", "max"]
BAR_TOP = 20
BAR_MAX_CATEGORIES = 25
PIE_MAX_CATEGORIES = 10
HISTOGRAM_BINS = 30
FALLBACK_GROUPS = 10
MAX_RECOMMENDATIONS = 5


def chart_data(df: DataFrame, chart_type: str, x: str, y: str | None = None,
               agg_func: str | None = None, color: str | None = None) -> DataFrame:
    """CHD-1..3: the table a bar / line / area / pie chart draws.

    With ``agg_func``: group by x (and colour) and aggregate y.  A bar
    without y: top 20 counts of x.  A pie: counts of every value of y
    (else of x).
    """
    if chart_type not in CHART_TYPES:
        raise OperatorError(f"Unknown chart type '{chart_type}'")
    require_columns(df, [x] + as_list(y) + as_list(color))
    if chart_type == "pie":
        return value_counts(df, y or x)
    if chart_type == "bar" and y is None:
        return value_counts(df, x, BAR_TOP)
    if y is None:
        raise OperatorError(f"{chart_type} chart needs y")
    keys = [col(x)] + ([col(color)] if color else [])
    if agg_func is None:
        return df.select(*keys, col(y)).orderBy(*keys)
    if agg_func not in CHART_AGGS:
        raise OperatorError(f"Unsupported aggregation '{agg_func}'")
    return _group_chart(df, [x, *as_list(color)], {y: y}, agg_func).orderBy(*keys)


def _group_chart(df: DataFrame, by: list[str], outputs: dict[str, str], agg_func: str) -> DataFrame:
    """Groups without a missing key, as charts draw them; the sum of no values is 0."""
    keyed = df
    for b in by:
        keyed = keyed.filter(col(b).isNotNull())
    if agg_func == "median":
        out = group_by_agg(keyed, by, {c: "median" for c in outputs.values()})
        return out.toDF(*by, *outputs)
    def stat(c):
        if agg_func == "sum":
            return F.coalesce(F.sum(c), F.lit(0))
        return F.count(c) if agg_func == "count" else _stat(agg_func, c)
    return keyed.groupBy(*[col(b) for b in by]).agg(*[stat(col(c)).alias(n) for n, c in outputs.items()])


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, color: str | None = None) -> DataFrame:
    """CHD-4: equal-width bins over [min, max]; the maximum goes to the last bin.

    Bin i (1-based) covers [lo_i, hi_i); empty bins are present with 0.
    Min and max come from one aggregate; the bin axis is ``range(bins)``.
    """
    require_batch(df, "histogram")
    require_numeric(df, [column])
    if bins < 1:
        raise OperatorError("bins must be positive")
    x = col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        raise OperatorError("no values to bin")
    width = (hi - lo) / bins if hi > lo else 1.0
    span = (hi - lo) if hi > lo else 1.0
    number = F.least(F.floor((x - F.lit(lo)) / F.lit(span) * F.lit(bins)) + 1, F.lit(bins)).cast("int")
    keys = [number.alias("bin")] + ([col(color)] if color else [])
    counts = df.filter(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    axis = df.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + (F.col("id") - 1) * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("bin_end"))
    if color:
        return axis.join(counts, "bin", "left").fillna(0, ["count"])
    return axis.join(counts, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def box_stats(df: DataFrame, y: str, x: str | None = None, whisker: float = 1.5) -> DataFrame:
    """CHD-5: quartiles, whiskers (extreme values inside the 1.5 IQR fences), outliers.

    Pass 1: counts and quartiles per group (``operators.quantile``).
    Pass 2: the group table (one row per group) is joined back and whiskers
    / outlier counts are aggregated.
    """
    require_numeric(df, [y])
    keys = [x] if x else []
    require_columns(df, keys)
    v = col(y).cast("double")
    base = df.filter(v.isNotNull())
    for k in keys:
        base = base.filter(col(k).isNotNull())
    counts = base.groupBy(*[col(k) for k in keys]).agg(F.count(v).alias("count"))
    quart = Q.quantile_wide(base, [y], (0.25, 0.5, 0.75), ["q1", "median", "q3"], keys).drop("column")
    q = counts.join(quart, keys) if keys else _side_by_side(counts, quart)
    q = q.withColumns({"lower_fence": F.col("q1") - whisker * (F.col("q3") - F.col("q1")),
                       "upper_fence": F.col("q3") + whisker * (F.col("q3") - F.col("q1"))})
    if not keys:
        # one group: the fences are two numbers, passed on as literals
        r = q.first()
        if r is None or r["q1"] is None:
            raise OperatorError("no values for a box plot")
        lo, hi = F.lit(r["lower_fence"]), F.lit(r["upper_fence"])
        inside = (v >= lo) & (v <= hi)
        w = base.agg(F.min(F.when(inside, v)).alias("whisker_low"),
                     F.max(F.when(inside, v)).alias("whisker_high"),
                     F.count_if(~inside).alias("outliers"))
        return w.select(F.lit(r["count"]).cast("long").alias("count"), F.lit(r["q1"]).alias("q1"),
                        F.lit(r["median"]).alias("median"), F.lit(r["q3"]).alias("q3"),
                        lo.alias("lower_fence"), hi.alias("upper_fence"),
                        "whisker_low", "whisker_high", "outliers")
    fences = q.select(col(keys[0]).alias("_tw_k0"), F.col("lower_fence").alias("_tw_lo"),
                      F.col("upper_fence").alias("_tw_hi"))
    # one row per group on the right: a many-to-one equi-join
    j = base.join(fences, col(keys[0]) == F.col("_tw_k0"))
    inside = (v >= F.col("_tw_lo")) & (v <= F.col("_tw_hi"))
    w = j.groupBy(col(keys[0])).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    return q.join(w, keys)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row tables as one row (the second is collected: one row)."""
    r = b.first()
    return a.select("*", *[F.lit(r[c] if r else None).cast(t).alias(c) for c, t in b.dtypes])


def scatter_data(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
                 sample: int | None = None, key=None) -> DataFrame:
    """CHD-6: the point table; optional exact reproducible sample of n points."""
    cols = [x, y] + as_list(color) + as_list(size)
    require_columns(df, cols)
    pts = df.select(*[col(c) for c in dict.fromkeys(cols + as_list(key))])
    if sample:
        pts = sample_rows(pts, n=sample, random_state=0, key=key)
    return pts.select(*[col(c) for c in dict.fromkeys(cols)])


def heatmap_data(df: DataFrame, columns=None, x: str | None = None, y: str | None = None,
                 value: str | None = None) -> DataFrame:
    """CHD-7/8: correlation matrix, mean pivot (long), or mean / count per x.

    * ``columns`` with two numeric ones or more: correlation matrix;
    * two categorical columns and a number: mean of the number per pair;
    * one categorical and a number: mean per category;
    * only x and y: mean of numeric y per x, else row count per x.
    """
    if columns:
        cols = require_columns(df, columns)
        nums = [c for c in cols if is_numeric(dtype_of(df, c))]
        cats = [c for c in cols if c not in nums]
        if len(nums) == len(cols) and len(nums) >= 2:
            return corr_matrix(df, nums)
        if len(nums) >= 2:
            return corr_matrix(df, nums)
        if len(cats) >= 2 and nums:
            a, b = cats[0], cats[1]
            base = df.filter(col(a).isNotNull() & col(b).isNotNull())
            return base.groupBy(col(a), col(b)).agg(F.avg(col(nums[0])).alias(nums[0]))
        if len(cats) == 1 and nums:
            return category_relation(df, cats[0], nums[0]).select(cats[0], F.col("mean").alias(nums[0]))
        raise OperatorError("heatmap needs numeric columns, or categories and a number")
    if x is None or y is None:
        raise OperatorError("give columns, or x and y")
    require_columns(df, [x, y])
    if value is not None:
        require_numeric(df, [value])
        return df.groupBy(col(x), col(y)).agg(F.avg(col(value)).alias(value))
    if is_numeric(dtype_of(df, y)):
        return df.filter(col(x).isNotNull()).groupBy(col(x)).agg(F.avg(col(y)).alias(y))
    return df.filter(col(x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias("count"))


def combo_data(df: DataFrame, x: str, y1: str, y2: str, color: str | None = None,
               agg_func: str | None = None) -> DataFrame:
    """CHD-9: two measures over x, optionally split by colour."""
    require_columns(df, [x, y1, y2] + as_list(color))
    keys = [col(x)] + ([col(color)] if color else [])
    if agg_func is None:
        return df.select(*keys, col(y1), col(y2)).orderBy(*keys)
    if agg_func not in CHART_AGGS:
        raise OperatorError(f"Unsupported aggregation '{agg_func}'")
    return _group_chart(df, [x, *as_list(color)], {y1: y1, y2: y2}, agg_func).orderBy(*keys)


def fallback_groups(df: DataFrame, x: str, y: str | None = None, agg_func: str = "count",
                    k: int = FALLBACK_GROUPS) -> DataFrame:
    """CHD-10: the first k groups (by x) of the aggregate; without y, the group sizes."""
    if y is None:
        require_columns(df, [x])
        data = df.filter(col(x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias("count"))
    else:
        data = chart_data(df, "bar", x, y, agg_func)
    return data.orderBy(col(x)).limit(k)


def dashboard(df: DataFrame, specs: list[dict]) -> dict[str, DataFrame]:
    """CHD-11: several charts over one table; the columns they need are written once (``freeze``),
    so nothing stays cached."""
    needed = sorted({c for s in specs for k in ("x", "y", "color", "y1", "y2") for c in as_list(s.get(k))})
    shared = freeze(df.select(*[col(c) for c in needed]), "dashboard") if needed else df
    out = {}
    for i, s in enumerate(specs):
        name = s.get("name", f"chart_{i}")
        kind = s["chart_type"]
        if kind == "histogram":
            out[name] = histogram(shared, s["x"], s.get("bins", HISTOGRAM_BINS))
        elif kind == "combo":
            out[name] = combo_data(shared, s["x"], s["y1"], s["y2"], s.get("color"), s.get("agg_func"))
        elif kind == "box":
            out[name] = box_stats(shared, s["y"], s.get("x"))
        else:
            out[name] = chart_data(shared, kind, s["x"], s.get("y"), s.get("agg_func"), s.get("color"))
    return out


# ---------------------------------------------------------------- checks

def suitability(profile: DataFrame) -> DataFrame:
    """CHK-1: is each profiled column fit for each chart kind, and why not.

    Input: ``column_profile`` output.  Rules: bar needs a categorical
    column, rejected above 25 distinct values when its cardinality is
    high; pie needs one too, of at most 10 distinct values; line rejects high-cardinality text;
    histogram / scatter / box need numbers.
    """
    kinds = F.array(*[F.lit(k) for k in ("bar", "pie", "line", "histogram", "scatter", "box")])
    p = profile.select("column", "kind", "cardinality", "n_distinct", F.explode(kinds).alias("chart"))
    numeric = F.col("kind") == "numeric"
    cat = F.col("kind") == "categorical"
    high = F.col("cardinality") == "high"
    reason = (F.when((F.col("chart") == "bar") & ~cat, "bar needs a categorical column")
              .when((F.col("chart") == "bar") & high & (F.col("n_distinct") > BAR_MAX_CATEGORIES),
                    "too many categories for a bar chart")
              .when((F.col("chart") == "pie") & ~cat, "pie needs a categorical column")
              .when((F.col("chart") == "pie") & (F.col("n_distinct") > PIE_MAX_CATEGORIES),
                    "too many categories for a pie chart")
              .when((F.col("chart") == "line") & cat & high, "high-cardinality text on a line chart")
              .when(F.col("chart").isin("histogram", "scatter", "box") & ~numeric,
                    "needs a numeric column"))
    return p.select("column", "chart", reason.isNull().alias("suitable"), reason.alias("reason"))


def compatibility(df: DataFrame, chart_type: str, x: str | None = None, y: str | None = None, columns=None) -> DataFrame:
    """CHK-2: check a chart request against the data (one distinct count).

    Columns that are not given are not checked.  Bar and pie: a bounded
    number of categories; line: x and y are numbers or dates; scatter: both
    are numbers; area, box, histogram: y (histogram: y or x) is a number;
    heatmap: at least two ``columns``, all of them there; correlation: the
    table has at least two numeric columns.  Returns one row: (chart, ok, reason).
    """
    if chart_type not in CHART_TYPES + ["correlation"]:
        raise OperatorError(f"Unknown chart type '{chart_type}'")
    require_columns(df, as_list(x) + as_list(y))
    spark = df.sparkSession
    reason = None

    def off(names, families):
        return next((c for c in names if c and family(dtype_of(df, c)) not in families), None)

    if chart_type in ("bar", "pie") and x:
        n = df.agg(F.count_distinct(col(x))).first()[0]
        limit = BAR_MAX_CATEGORIES if chart_type == "bar" else PIE_MAX_CATEGORIES
        if n > limit:
            reason = f"{x} has {n} categories (at most {limit})"
    elif chart_type == "line":
        wrong = off((x, y), ("number", "datetime", "date"))
        reason = f"{wrong} must be numeric or a date" if wrong else None
    elif chart_type == "scatter":
        wrong = off((x, y), ("number",))
        reason = f"{wrong} must be numeric" if wrong else None
    elif chart_type in ("area", "box"):
        reason = f"{chart_type} needs a numeric y column" if off((y,), ("number",)) else None
    elif chart_type == "histogram":
        target = y or x
        if not target or off((target,), ("number",)):
            reason = "histogram needs a numeric column"
    elif chart_type == "heatmap":
        names = as_list(columns) or [c for c in (x, y) if c]
        missing = [c for c in names if c not in df.columns]
        if len(names) < 2:
            reason = "heatmap needs at least two columns"
        elif missing:
            reason = f"heatmap columns not in the table: {', '.join(missing)}"
    elif chart_type == "correlation" and len(numeric_columns(df)) < 2:
        reason = "needs at least two numeric columns"
    return spark.createDataFrame([(chart_type, reason is None, reason)],
                                 "chart string, ok boolean, reason string")


def recommend_charts(df: DataFrame, k: int = MAX_RECOMMENDATIONS, approx: bool = False) -> DataFrame:
    """CHK-3: rule-based chart ranking from the chart statistics.

    date + number -> line; strongly correlated pair -> scatter;
    category (one of few values first) + number -> bar; number -> histogram;
    category of low cardinality -> pie.  At most ``k`` in that order.
    """
    require_batch(df, "recommend_charts")
    # of the chart statistics only kinds, the categories' cardinality and strong pairs are needed
    nums = numeric_columns(df)
    dates = [c for c in df.columns if c not in nums and family(dtype_of(df, c)) == "datetime"]
    names = [c for c in df.columns if c not in nums and c not in dates]
    n_distinct = {r["column"]: r["n_unique"] for r in nunique(df, names, approx).collect()} if names else {}
    low, mid = CHART_CARDINALITY
    cats = [{"column": c, "cardinality": "low" if n_distinct.get(c, 0) < low else "medium" if n_distinct.get(c, 0) < mid else "high"} for c in names]
    recs = []
    if dates and nums:
        recs.append(("line", dates[0], nums[0], f"trend of {nums[0]} over {dates[0]}"))
    if len(nums) >= 2:
        from .aggregate import strong_correlations
        place = {c: i for i, c in enumerate(nums)}
        strong = sorted((sorted((place[r["col_x"]], place[r["col_y"]])), r["r"]) for r in strong_correlations(
            df, nums, k=len(nums) * len(nums)).collect())
        if strong:  # the first pair in column order
            (i, j), r = strong[0]
            s = {"col_x": nums[i], "col_y": nums[j], "r": r}
            recs.append(("scatter", s["col_x"], s["col_y"], f"correlation r={s['r']:.2f}"))
    low_cats = [r for r in cats if r["cardinality"] in ("low", "medium")] or cats
    if low_cats and nums:
        recs.append(("bar", low_cats[0]["column"], nums[0], f"{nums[0]} by {low_cats[0]['column']}"))
    if nums:
        recs.append(("histogram", nums[0], None, f"distribution of {nums[0]}"))
    pie = [r for r in cats if r["cardinality"] == "low"]
    if pie:
        recs.append(("pie", pie[0]["column"], None, f"share of {pie[0]['column']}"))
    rows = [(i + 1, *r) for i, r in enumerate(recs[:k])]
    return df.sparkSession.createDataFrame(rows, "rank int, chart string, x string, y string, reason string")


__all__ = ["chart_data", "histogram", "box_stats", "scatter_data", "heatmap_data", "combo_data",
           "fallback_groups", "dashboard", "suitability", "compatibility", "recommend_charts"]
