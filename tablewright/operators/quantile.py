"""Exact quantiles by sketch-bracketed selection (AGG-23 and every operator needing quartiles).

Nothing is sorted, written or moved but a small part of the values:

1. one aggregate makes a mergeable quantile sketch (KLL) per (group, column) and reads
   off a value below and one above each wanted rank: a bracket;
2. one aggregate counts exactly what lies below and inside every bracket.  A bracket
   that misses its rank is opened to that side; one with more than `LIMIT` rows is
   narrowed by a sketch of what lies strictly inside it, and counted again;
3. only values inside brackets are counted by value (with map-side combination, so a
   value shared by a third of the rows is one row), cumulated from the exact count
   below, and read off at the two ranks around the quantile.

A group of few rows has the whole value range as bracket.  The brackets of a whole
table are literals of the plan; those of groups are one row per group, joined by key
(Spark broadcasts them if they are small).  A window holds at most `LIMIT` different
values and the two ends.  ``strategy="approx"`` uses ``percentile_approx`` instead.

Interpolation is linear between the two closest ranks, as pandas'
``quantile`` and SQL's ``quantile_cont`` do.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..order import freeze
from ..schema import OperatorError, as_list, col

STRATEGIES = ("exact", "approx")
#: Rows strictly inside a bracket beyond which it is narrowed once more.
LIMIT = 200_000
#: Groups up to this size have the whole range as bracket.
SMALL = 4000
#: Size of a sketch, and how far a bracket reaches beyond its rank (several times the sketch's
#: usual error; a bracket that misses all the same is opened, so the result is exact).
SKETCH, MARGIN = 1024, 0.005
#: Steps of the grid by which brackets are narrowed.
GRID = 100
#: Bounds of an open bracket: NaN is Spark's largest double.
LEAST, MOST = float("-inf"), float("nan")


def _not_null(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & col(c).isNotNull()
    return cond


def _sketch_table(df: DataFrame, columns: list[str], qs: list[float], by: list[str]) -> DataFrame:
    aggs = [F.percentile_approx(col(c).cast("double"), qs, 10000).alias(f"_tw{i}") for i, c in enumerate(columns)]
    keys = [col(b) for b in by]
    wide = df.filter(_not_null(by)).groupBy(*keys).agg(*aggs) if by else df.agg(*aggs)
    long = wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_tw{i}").alias("_tw_vals")) for i, c in enumerate(columns)])))
    return long.select(*keys, "column", F.posexplode(F.col("_tw_vals"))).select(
        *keys, "column", F.element_at(F.array(*map(F.lit, qs)), F.col("pos") + 1).alias("q"), F.col("col").alias("value"))


class _Brackets:
    """Brackets of every (group, column, quantile): one row per group, or one of literals.

    Columns: n{i} values of column i, and for quantile j of it the bounds l{i}_{j} and h{i}_{j}."""

    def __init__(self, wide: DataFrame, keys: list[str]):
        self.keys = keys
        self.names = [c for c in wide.columns if c not in keys]
        self.table = freeze(wide, "quantile") if keys else None
        self.values = None if keys else wide.first().asDict()

    def on(self, rows: DataFrame, names=None) -> DataFrame:
        """The rows, each with its group's brackets."""
        names = names or self.names
        if not self.keys:
            return rows.select("*", *[F.lit(self.values[c]).alias(c) for c in names])
        table = self.table.select(*[F.col(k).alias("_g" + k) for k in self.keys], *names)
        return rows.join(table, [F.col(k) == F.col("_g" + k) for k in self.keys]).drop(*["_g" + k for k in self.keys])

    def with_sums(self, rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """One row per group: the brackets and sums over the group's rows (conditions may use both)."""
        exprs = [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(k) for k, c in sums.items()]
        if not self.keys:
            return self.on(self.on(rows).agg(*exprs))
        return self.on(self.on(rows).groupBy(*self.keys).agg(*exprs))


def _exact_table(df: DataFrame, columns: list[str], qs: list[float], by: list[str]) -> DataFrame:
    """Long (by..., column, q, value) by sketched brackets."""
    keys = [f"_tw_k{i}" for i in range(len(by))]
    rows = df.filter(_not_null(by)).select(*[col(b).alias(k) for b, k in zip(by, keys)],
                                           *[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    every = [(i, j) for i in range(len(columns)) for j in range(len(qs))]

    def rank(i, j):
        return (F.col(f"n{i}") - 1) * F.lit(qs[j])

    # 1. sketch
    probes = [p for q in qs for p in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    read = F.array(*map(F.lit, probes))
    exprs = [e for i in range(len(columns)) for e in (F.count(f"v{i}").alias(f"n{i}"), F.kll_sketch_agg_double(f"v{i}", F.lit(SKETCH)).alias(f"k{i}"))]
    wide = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(*exprs)
    few = {i: F.col(f"n{i}") <= SMALL for i in range(len(columns))}
    wide = wide.select(*keys, *[f"n{i}" for i in range(len(columns))], *[
        F.when(~few[i], F.kll_sketch_get_quantile_double(f"k{i}", read)).alias(f"p{i}") for i in range(len(columns))])
    state = _Brackets(wide.select(*keys, *[f"n{i}" for i in range(len(columns))], *[e for i, j in every for e in (
        F.coalesce(F.get(f"p{i}", F.lit(2 * j)), F.lit(LEAST)).alias(f"l{i}_{j}"), F.coalesce(F.get(f"p{i}", F.lit(2 * j + 1)), F.lit(MOST)).alias(f"h{i}_{j}"))]), keys)

    # 2. count, and narrow what is too wide
    state, widest = _counted(rows, state, every, rank)
    before = math.inf
    while LIMIT < widest < before:  # each round leaves about a fiftieth; values that fill a bracket may stay
        before = widest
        state, widest = _counted(rows, _narrowed(rows, state, every, rank), every, rank)

    # 3. pick: rows outside all brackets go before anything is made of them
    def held(i, js):
        return [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"n{i}").alias("n"), F.col(f"b{i}_{j}").alias("b"), F.col(f"v{i}").alias("v"),
                         F.col(f"v{i}").between(F.col(f"l{i}_{j}"), F.col(f"h{i}_{j}")).alias("inside")) for j in js]

    def any_of(pairs):
        return functools.reduce(operator.or_, [F.col(f"v{i}").between(F.col(f"l{i}_{j}"), F.col(f"h{i}_{j}")) for i, j in pairs])

    if keys:
        inside = state.on(rows).where(any_of(every)).select(*keys, F.inline(F.array(*[x for i in range(len(columns)) for x in held(i, range(len(qs)))])))
    else:  # each column's brackets are ranges of literals, which reach its own scan
        parts = [state.on(rows.select(f"v{i}"), [f"n{i}", *[f"{x}{i}_{j}" for j in range(len(qs)) for x in "lhb"]]).where(
            any_of([(i, j) for j in range(len(qs))])).select(F.inline(F.array(*held(i, range(len(qs)))))) for i in range(len(columns))]
        inside = functools.reduce(DataFrame.unionByName, parts)
    inside = inside.where("inside")
    counts = inside.groupBy(*keys, "i", "j", "n", "b", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("b") + F.sum("c").over(Window.partitionBy(*keys, "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    q = F.element_at(F.array(*map(F.lit, qs)), F.col("j") + 1)
    at = counts.select(*keys, "i", "j", "v", "c", upto.alias("end"), ((F.col("n") - 1) * q).alias("h"))

    def holding(r):
        return F.max(F.when((F.col("end") - F.col("c") <= r) & (r < F.col("end")), F.col("v")))

    g = at.groupBy(*keys, "i", "j").agg(holding(F.floor("h")).alias("lo"), holding(F.ceil("h")).alias("hi"), F.max("h").alias("h"))
    lo, hi = F.floor("h"), F.ceil("h")
    value = F.when(lo == hi, F.col("lo")).otherwise((hi - F.col("h")) * F.col("lo") + (F.col("h") - lo) * F.col("hi"))
    out = g.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("column"), q.alias("q"),
                   value.alias("value"), *([] if by else ["i", "j"]))
    if by:
        return out
    # whole table: every column has its rows, NULL where it has no values
    got = {(r["i"], r["j"]): r["value"] for r in out.collect()}
    return df.sparkSession.createDataFrame([(columns[i], qs[j], got.get((i, j))) for i, j in every], "column string, q double, value double")


def _bounds(i: int, j: int) -> tuple[Column, Column, Column]:
    return F.col(f"v{i}"), F.col(f"l{i}_{j}"), F.col(f"h{i}_{j}")


def _counted(rows, state, every, rank):
    """The brackets with b (rows below) and s (rows inside), and the largest s.  A bracket that
    misses its rank is opened to that side."""
    keys, sums = state.keys, {}
    for i, j in every:
        v, lo, hi = _bounds(i, j)
        sums |= {f"b{i}_{j}": v < lo, f"t{i}_{j}": v <= hi}
    wide = state.with_sums(rows, sums)
    out, spans = [*keys, *dict.fromkeys(f"n{i}" for i, _ in every)], []
    for i, j in every:
        n, b, t = F.col(f"n{i}"), F.coalesce(f"b{i}_{j}", F.lit(0)), F.coalesce(f"t{i}_{j}", F.lit(0))
        under, over = F.floor(rank(i, j)) < b, F.ceil(rank(i, j)) >= t
        b2, t2 = F.when(under, F.lit(0)).otherwise(b), F.when(over, n).otherwise(t)
        out += [F.when(under, F.lit(LEAST)).otherwise(F.col(f"l{i}_{j}")).alias(f"l{i}_{j}"), F.when(over, F.lit(MOST)).otherwise(F.col(f"h{i}_{j}")).alias(f"h{i}_{j}"),
                b2.cast("long").alias(f"b{i}_{j}"), (t2 - b2).cast("long").alias(f"s{i}_{j}")]
        spans.append(f"s{i}_{j}")
    state = _Brackets(wide.select(*out), keys)
    if not keys:
        return state, max(state.values[c] for c in spans)
    return state, state.table.agg(F.max(F.greatest(F.lit(0), *map(F.col, spans)))).first()[0] or 0


def _narrowed(rows, state, every, rank):
    """Closer bounds for the brackets over LIMIT, from a sketch of the values strictly inside them;
    a rank at a bound itself keeps that bound."""
    keys, sums, sketches = state.keys, {}, []
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    for i, j in every:
        v, lo, hi = _bounds(i, j)
        wide = F.col(f"s{i}_{j}") > LIMIT
        sums |= {f"a{i}_{j}": wide & (v <= lo), f"u{i}_{j}": wide & (v < hi)}
        sketches.append(F.kll_sketch_agg_double(F.when(wide & (v > lo) & (v < hi), v), F.lit(SKETCH)).alias(f"k{i}_{j}"))
    frame = state.on(rows)
    exprs = [*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(k) for k, c in sums.items()], *sketches]
    got = state.on((frame.groupBy(*keys) if keys else frame.groupBy()).agg(*exprs))
    out = [*keys, *dict.fromkeys(f"n{i}" for i, _ in every)]
    for i, j in every:
        a, inside = F.col(f"a{i}_{j}"), F.col(f"u{i}_{j}") - F.col(f"a{i}_{j}")
        wide = (F.col(f"s{i}_{j}") > LIMIT) & (inside > 0)
        p = F.when(wide, F.kll_sketch_get_quantile_double(f"k{i}_{j}", grid))
        step = F.lit(float(GRID)) / F.greatest(inside, F.lit(1))
        left = F.floor((F.floor(rank(i, j)) - a) * step).cast("int") - 2
        right = F.ceil((F.ceil(rank(i, j)) - a + 1) * step).cast("int") + 2
        out += [F.when(wide & (left >= 0), F.get(p, F.least(left, F.lit(GRID)))).otherwise(F.col(f"l{i}_{j}")).alias(f"l{i}_{j}"),
                F.when(wide & (right <= GRID), F.get(p, F.greatest(right, F.lit(0)))).otherwise(F.col(f"h{i}_{j}")).alias(f"h{i}_{j}")]
    return _Brackets(got.select(*out), keys)


def quantile_table(df: DataFrame, columns, qs, by=None, strategy: str = "exact") -> DataFrame:
    """Long ``(by..., column, q, value)`` of exact (or approximate) quantiles."""
    if strategy not in STRATEGIES:
        raise OperatorError(f"strategy must be one of {', '.join(STRATEGIES)}")
    qs = [float(q) for q in qs]
    if any(not (0.0 <= q <= 1.0) or math.isnan(q) for q in qs):
        raise OperatorError("quantiles must be in [0, 1]")
    table = _sketch_table if strategy == "approx" else _exact_table
    return table(df, as_list(columns), qs, as_list(by))


def quantile_values(df: DataFrame, columns, qs, strategy: str = "exact") -> dict[str, list]:
    """Whole-table quantiles as Python numbers ({column: [value per q]})."""
    cols = as_list(columns)
    qs = [float(q) for q in qs]
    rows = quantile_table(df, cols, qs, None, strategy).collect()
    out = {c: [None] * len(qs) for c in cols}
    for r in rows:
        out[r["column"]][qs.index(r["q"])] = r["value"]
    return out


def quantile_wide(df: DataFrame, columns, qs, names, by=None, strategy: str = "exact") -> DataFrame:
    """``(by..., column, <name per q>)``: one row per (group, column)."""
    by = as_list(by)
    long = quantile_table(df, columns, qs, by, strategy)
    return long.groupBy(*[col(b) for b in by], "column").agg(
        *[F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(n) for q, n in zip(qs, names)])
