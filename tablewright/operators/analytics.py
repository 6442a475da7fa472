"""Time and user analytics (WIN-7..15).

Ordered windows are written so that no single group has to sit in one
task, and one plan serves every size: rows get their rank inside their group
from one global sort (``group_rank``), are cut into blocks of ``block_rows``
consecutive rows, and each block is windowed on its own.  Running totals then add the
sum of earlier blocks (a table with one row per block); rolling windows copy
the last ``k - 1`` rows of each block into the next one (a halo), so every
row sees its full frame; ntile and percent rank come from exact ranks and
group sizes; growth joins each period to the one ranked before it.  A user
holding a third of all events is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..order import group_rank, with_position
from ..schema import OperatorError, as_list, col, dtype_of, is_numeric, require_batch, require_columns, require_numeric
from .aggregate import _stat, group_by_agg

RANK = "_tw_r"
BLOCK = "_tw_blk"
DEFAULT_BLOCK_ROWS = 1 << 20


def _ranked(df: DataFrame, partition_by, order_by, total: str | None = None) -> DataFrame:
    pb = as_list(partition_by)
    if pb:
        return group_rank(df, pb, order_by, name=RANK, size=total)
    return with_position(df, order_by, name=RANK, total=total)


def running_total(df: DataFrame, value: str, order_by, partition_by=None, name: str = "running_total",
                  block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """WIN-10: cumulative sum in ``order_by`` order (per ``partition_by`` group).

    A NULL adds nothing: its row shows the total so far, NULL before the first value."""
    require_batch(df, "running_total")
    require_numeric(df, [value])
    pb = require_columns(df, as_list(partition_by))
    r = _ranked(df, pb, order_by).withColumn(BLOCK, F.floor(F.col(RANK) / F.lit(block_rows)))
    inside = Window.partitionBy(*[col(p) for p in pb], F.col(BLOCK)).orderBy(RANK).rowsBetween(
        Window.unboundedPreceding, 0)
    local = r.withColumn("_tw_loc", F.sum(col(value)).over(inside))
    blocks = r.groupBy(*[col(p) for p in pb], F.col(BLOCK)).agg(F.sum(col(value)).alias("_tw_bs"))
    before = Window.partitionBy(*[col(p) for p in pb]).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1)
    prefix = blocks.select(*[col(p).alias(f"_tw_k_{i}") for i, p in enumerate(pb)], F.col(BLOCK).alias("_tw_b2"),
                           F.sum("_tw_bs").over(before).alias("_tw_pre"))
    cond = F.col(BLOCK) == F.col("_tw_b2")
    for i, p in enumerate(pb):
        cond = cond & col(p).eqNullSafe(F.col(f"_tw_k_{i}"))
    out = local.join(prefix, cond)
    return out.select(*[col(c) for c in df.columns],
                      F.coalesce(F.col("_tw_loc") + F.col("_tw_pre"), F.col("_tw_loc"), F.col("_tw_pre")).alias(name))


def rolling(df: DataFrame, value: str, window: int, order_by, partition_by=None, fn: str = "mean",
            name: str | None = None, min_periods: int | None = None,
            block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """WIN-9: moving aggregate over the current and ``window - 1`` earlier rows.

    Like pandas ``rolling(window)``: NULL until ``min_periods`` (default:
    ``window``) rows are in the frame.
    """
    require_batch(df, "rolling")
    require_numeric(df, [value])
    if window < 1:
        raise OperatorError("window must be at least 1")
    block_rows = max(block_rows, window)
    min_periods = window if min_periods is None else min_periods
    pb = require_columns(df, as_list(partition_by))
    x = col(value).cast("double")
    r = _ranked(df, pb, order_by).withColumn(BLOCK, F.floor(F.col(RANK) / F.lit(block_rows)))
    r = r.withColumn("_tw_halo", F.lit(False))
    # copy the last window-1 rows of each block into the next block
    halo = r.filter(F.pmod(F.col(RANK), F.lit(block_rows)) >= F.lit(block_rows - (window - 1))) \
        .withColumn(BLOCK, F.col(BLOCK) + 1).withColumn("_tw_halo", F.lit(True))
    both = r.unionByName(halo) if window > 1 else r
    frame = Window.partitionBy(*[col(p) for p in pb], F.col(BLOCK)).orderBy(RANK).rowsBetween(
        -(window - 1), 0)
    stat = _stat(fn, x).over(frame)
    n = F.count(x).over(frame)
    out = both.withColumn("_tw_stat", F.when(n >= min_periods, stat)).filter(~F.col("_tw_halo"))
    return out.select(*[col(c) for c in df.columns],
                      F.col("_tw_stat").alias(name or f"{value}_rolling_{fn}"))


def ntile(df: DataFrame, value: str, n: int = 10, tie_break=None, partition_by=None,
          name: str = "ntile") -> DataFrame:
    """WIN-11: bucket 1..n by rank, sizes differing by at most one (first buckets larger).

    Computed from the exact position and row count, so no window has to hold
    a whole group (``ntile`` over a window would).
    """
    require_batch(df, "ntile")
    require_columns(df, [value])
    order = [value] + as_list(tie_break)
    require_columns(df, as_list(partition_by))
    r = _ranked(df, partition_by, order, total="_tw_n")
    pos, total = F.col(RANK), F.col("_tw_n")
    q, rem = F.floor(total / n), F.pmod(total, F.lit(n))
    big = rem * (q + 1)
    bucket = F.when(pos < big, F.floor(pos / (q + 1)) + 1).otherwise(
        rem + F.floor((pos - big) / q) + 1)
    return r.select(*[col(c) for c in df.columns], bucket.cast("int").alias(name))


def percent_rank(df: DataFrame, value: str, partition_by=None, name: str = "percent_rank") -> DataFrame:
    """WIN-11: (rank - 1) / (rows - 1) with ties sharing the lowest rank; 0 for one row.

    One global sort on (partition, value); the start of each run of equal
    values (and of each partition) comes from ``run_starts``, so neither a hot
    value nor a hot partition sits in one task.
    """
    from ..order import run_starts
    require_batch(df, "percent_rank")
    require_columns(df, [value])
    pb = require_columns(df, as_list(partition_by))
    keys = [col(p).asc_nulls_last() for p in pb] + [col(value).asc_nulls_first()]
    pos = with_position(df, keys, name=RANK, keep_partition=True, total="_tw_n")
    tie = run_starts(pos, pb + [value], RANK, "_tw_t")
    if pb:
        part = run_starts(tie, pb, RANK, "_tw_q")
        rank0, rows = F.col("_tw_t_start") - F.col("_tw_q_start"), F.col("_tw_q_size")
    else:
        part, rank0, rows = tie, F.col("_tw_t_start"), F.col("_tw_n")
    pr = F.when(rows <= 1, F.lit(0.0)).otherwise(rank0 / (rows - 1))
    return part.select(*[col(c) for c in df.columns], pr.alias(name))


def growth_pct(df: DataFrame, time: str, value: str, by=None, agg: str = "sum",
               first_zero: bool = True, name: str = "growth_pct") -> DataFrame:
    """WIN-8: aggregate per (group, period), then percent change along periods.

    First period is 0 (``first_zero``); a zero base gives NULL, not inf.
    The change runs on the aggregated table (one row per group and period),
    an equi-join of each period with the one ranked just before it, so a
    series with billions of periods is not held by one task.  The sum of a
    group without values is 0.
    """
    by = require_columns(df, as_list(by))
    require_columns(df, [time])
    require_numeric(df, [value])
    keys = [col(b) for b in by]
    keyed = df
    for b in by:
        keyed = keyed.filter(col(b).isNotNull())
    if agg == "median":
        g = group_by_agg(keyed, [*by, time], {value: agg})
    else:
        total = F.coalesce(F.sum(col(value)), F.lit(0)) if agg == "sum" else _stat(agg, col(value))
        g = keyed.groupBy(*keys, col(time)).agg(total.alias(value))

    def change(cur: Column, prev: Column, first: Column) -> Column:
        out = F.try_divide((cur - prev) * 100.0, prev)
        return F.when(first, F.lit(0.0)).otherwise(out) if first_zero else out

    ranked = _ranked(g, by, [time])
    before = ranked.select(*[col(b).alias(f"_tw_p{i}") for i, b in enumerate(by)],
                           (F.col(RANK) + 1).alias("_tw_next"), col(value).alias("_tw_prev"))
    cond = F.col(RANK) == F.col("_tw_next")
    for i, b in enumerate(by):
        cond = cond & col(b).eqNullSafe(F.col(f"_tw_p{i}"))
    j = ranked.join(before, cond, "left")
    return j.select(*keys, col(time), col(value),
                    change(col(value), F.col("_tw_prev"), F.col(RANK) == 0).alias(name))


def period_growth(df: DataFrame, ts: str, value: str, unit: str = "month", by=None,
                  agg: str = "sum", name: str = "growth_pct") -> DataFrame:
    """WIN-12: month-over-month / year-over-year growth on truncated periods."""
    if unit not in ("year", "quarter", "month", "week", "day"):
        raise OperatorError("unit must be year, quarter, month, week or day")
    require_columns(df, [ts])
    with_p = df.withColumn("period", F.date_trunc(unit, col(ts)).cast("timestamp_ntz"))
    return growth_pct(with_p, "period", value, by, agg, name=name)


def best_row_per_group(df: DataFrame, by, value: str, largest: bool = True, tie_break=None) -> DataFrame:
    """WIN-7: the full row with the max (min) ``value`` per group.

    ``min_by`` over a struct of the row is a partial aggregate: each task keeps
    one candidate per group (per group and value for the largest text or date),
    so a hot group costs no shuffle volume.  Ties go to the smallest
    ``tie_break``; groups whose value is all NULL give no row.
    """
    by = require_columns(df, as_list(by))
    require_columns(df, [value])
    tb = require_columns(df, as_list(tie_break))
    others = [c for c in df.columns if c not in by]
    row = F.struct(*[col(c) for c in others])
    ties = [col(t) for t in tb]
    base = df.filter(col(value).isNotNull())
    for b in by:
        base = base.filter(col(b).isNotNull())
    keys = [col(b) for b in by]
    if not largest:
        agg = base.groupBy(*keys).agg(F.min_by(row, F.struct(col(value), *ties)).alias("_tw_row"))
    elif is_numeric(dtype_of(df, value)):
        agg = base.groupBy(*keys).agg(F.min_by(row, F.struct(-col(value), *ties)).alias("_tw_row"))
    else:  # text and dates have no negative: the best row of each value, then of the largest value
        best = base.groupBy(*keys, col(value).alias("_tw_v")).agg(
            F.min_by(row, F.struct(F.lit(0), *ties)).alias("_tw_row"))
        agg = best.groupBy(*keys).agg(F.max_by("_tw_row", "_tw_v").alias("_tw_row"))
    return agg.select(*[F.col("_tw_row").getField(c).alias(c) if c in others else col(c)
                        for c in df.columns])


def cohort_retention(df: DataFrame, user: str, ts: str, unit: str = "month") -> DataFrame:
    """WIN-13: users active k periods after their first period, per cohort.

    Events are first reduced to distinct (user, period) pairs (partial
    aggregation), so a very active user adds only one row per period.
    """
    require_batch(df, "cohort_retention")
    require_columns(df, [user, ts])
    if unit not in ("month", "week", "day"):
        raise OperatorError("unit must be month, week or day")
    periods = df.filter(col(user).isNotNull() & col(ts).isNotNull()).select(
        col(user).alias("user"), F.date_trunc(unit, col(ts)).cast("timestamp_ntz").alias("period")
    ).distinct()
    cohorts = periods.groupBy("user").agg(F.min("period").alias("cohort"))
    joined = periods.join(cohorts, "user")
    if unit == "month":
        offset = (F.year("period") - F.year("cohort")) * 12 + F.month("period") - F.month("cohort")
    elif unit == "week":
        offset = F.floor(F.datediff(F.col("period"), F.col("cohort")) / 7)
    else:
        offset = F.datediff(F.col("period"), F.col("cohort"))
    counts = joined.groupBy("cohort", offset.cast("int").alias("period_offset")).agg(
        F.count(F.lit(1)).alias("users"))
    sizes = counts.filter(F.col("period_offset") == 0).select(
        F.col("cohort").alias("_tw_c"), F.col("users").alias("cohort_size"))
    out = counts.join(sizes, counts["cohort"] == sizes["_tw_c"]).drop("_tw_c")
    return out.withColumn("retention_pct", F.round(F.col("users") * 100.0 / F.col("cohort_size"), 4))


def funnel(df: DataFrame, user: str, ts: str, step_column: str, steps: list, block: str = "hour") -> DataFrame:
    """WIN-14: users reaching each step in order.

    Step 1 time = a user's first event of step 1; step i time = the
    user's first event of step i at or after the step i-1 time.

    One scan for any number of steps (62 at most).  All events of a user at one
    time are one bit mask of steps; the masks of a ``block`` of time become a
    map from steps reached before to steps reached after it; maps of
    consecutive blocks compose, and a user's composition says how far they came
    from no step at all.  A very active user's events are so spread over many
    tasks, and only one small map per block meets in one row.
    """
    require_batch(df, "funnel")
    require_columns(df, [user, ts, step_column])
    if not 2 <= len(steps) <= 62:
        raise OperatorError("a funnel needs two to 62 steps")
    masks = {}
    for i, s in enumerate(steps):
        masks[s] = masks.get(s, 0) | 1 << i
    mask = F.lit(None).cast("long")
    for s, m in masks.items():
        mask = F.when(col(step_column) == F.lit(s), F.lit(m).cast("long")).otherwise(mask)
    events = df.select(col(user).alias("u"), col(ts).alias("t"), mask.alias("m")).filter(
        F.col("u").isNotNull() & F.col("t").isNotNull() & F.col("m").isNotNull())
    instants = events.groupBy("u", "t").agg(F.bit_or("m").alias("m"))

    def onward(reached: Column, m: Column) -> Column:
        """Steps reached after an instant: on over all set bits from `reached` upwards."""
        x = F.call_function("shiftright", m, reached)
        return (reached + F.bit_count(x.bitwiseXOR(x + 1)) - 1).cast("int")

    in_block = F.transform(F.array_sort(F.collect_list(F.struct("t", "m"))), lambda e: e["m"])
    blocks = instants.groupBy("u", F.date_trunc(block, "t").alias("b")).agg(in_block.alias("ms")).select("u", "b", F.transform(
        F.sequence(F.lit(0), F.lit(len(steps))), lambda k: F.aggregate("ms", k, onward)).alias("after"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("b", "after"))), lambda e: e["after"])
    reached = blocks.groupBy("u").agg(in_order.alias("maps")).select(
        F.aggregate("maps", F.lit(0), lambda k, after: F.get(after, k)).alias("k"))
    row = reached.agg(*[F.count_if(F.col("k") >= i).alias(f"s{i}") for i in range(1, len(steps) + 1)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step_index"), F.lit(str(s)).alias("step"), F.col(f"s{i}").alias("users"))
                                         for i, s in enumerate(steps, 1)])))


def trend(df: DataFrame, ts: str, value: str | None = None, unit: str = "day", fn: str = "sum") -> DataFrame:
    """WIN-15: a metric per truncated period (count of rows without ``value``)."""
    require_columns(df, [ts])
    period = F.date_trunc(unit, col(ts)).cast("timestamp_ntz").alias("period")
    if value is None:
        return df.groupBy(period).agg(F.count(F.lit(1)).alias("count"))
    require_columns(df, [value])
    if fn == "median":
        return group_by_agg(df.withColumn("period", period), ["period"], {value: fn})
    return df.groupBy(period).agg(_stat(fn, col(value)).alias(value))
