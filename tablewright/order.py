"""Row order on a distributed table.

A Spark table has no row order, yet positional operators (drop by
position, slice, forward fill, interpolation, joins on the row index) need
one.  Every such operator therefore takes an explicit ``order_by`` that
must be a *total* order (add a key column as tie-break).

``with_position`` gives each row its exact 0-based position in that order
without moving all rows through one task (``Window.orderBy`` without a
partition key does exactly that):

1. ``orderBy`` range-partitions and sorts the table (a distributed sort;
   range bounds are sampled on the full sort key, so even a heavy leading
   value is split as long as the order is total);
2. the sorted table is written as Parquet into the shared checkpoint
   folder (``spark.checkpoint.dir``).  This cuts the lineage - a lost
   executor cannot re-sample different range bounds - and every task's
   sorted run becomes one file;
3. the row count of each file comes from a scan that reads no column
   data; a row's position is then the offset of its file plus
   ``_metadata.row_index``, its index inside the file.  The offsets are a
   joined table with one row per file (bounded by the sort's partition
   count).  Later scans of the sorted table keep column pruning and filter
   pushdown.

These positions are an index kept beside the table (``Positions``): slices,
positional drops and ordered fills hand it on to what they return, so that a
further positional operator in the same order sorts and writes nothing, and
a slice opens only the files that hold its positions.  ``index_table`` makes
such a table once for many operators.

``carry`` uses the file of each row as a block for a two-phase fill: fill
inside each block, then carry the last (or first) non-null value of
earlier (or later) blocks across, through a table with one row per block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import OperatorError, as_list, col, require_columns
from .session import ensure_checkpoint_dir

PID = "_tw_pid"
POS = "_tw_pos"
TOTAL = "_tw_total"


def order_columns(df: DataFrame, order_by, ascending=True, nulls_last=True) -> list[Column]:
    """Turn names / Columns plus directions into sort expressions."""
    items = as_list(order_by)
    if not items:
        raise OperatorError("order_by must name at least one column")
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(items)
    if len(asc) != len(items):
        raise OperatorError("ascending must have one entry per order column")
    out = []
    for item, a in zip(items, asc):
        if isinstance(item, Column):
            out.append(item)
            continue
        require_columns(df, [item])
        c = col(item)
        if a:
            out.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
        else:
            out.append(c.desc_nulls_last() if nulls_last else c.desc_nulls_first())
    return out


def largest_group(df: DataFrame, by, limit: int) -> int:
    """Rows of the largest ``by`` group (whole table without ``by``), capped at ``limit + 1``.

    Lets an operator use a plain window when every group fits one task and
    the distributed block path otherwise.  Without groups this stops after
    ``limit + 1`` rows; with groups it is one partially aggregated count.
    """
    by = as_list(by)
    if not by:
        return df.limit(limit + 1).count()
    top = df.groupBy(*[col(b) for b in by]).count().agg(F.max("count")).first()[0]
    return top or 0


def scratch_table_path(df: DataFrame, kind: str) -> str:
    """A new folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    return f"{root}/tw-{kind}/{uuid.uuid4().hex}"


def freeze(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write a plan as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: later actions (and recovery from a lost executor)
    start from the written files, not from a recomputation.
    """
    path = scratch_table_path(df, kind)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_PART = re.compile(r"part-(\d+)")


def _file_order(name: str):
    """Task order of a written part file (``part-<task>-...-c<nnn>``)."""
    m = _PART.match(name)
    return (int(m.group(1)) if m else -1, name)


@dataclass(frozen=True)
class Positions:
    """Row positions kept beside a table.

    ``key`` is the order they follow; ``rows(lo, hi)`` gives the table's columns, ``POS`` and
    the block ``PID`` of at least the rows at positions ``lo <= p < hi``; ``total`` counts all.
    """

    key: tuple | None
    rows: Callable[[int, int], DataFrame]
    total: int

    def columns(self) -> set[str]:
        return {name for name, _ in self.key}


def order_key(order_by, ascending=True) -> tuple | None:
    """An order by column names in comparable form; None for orders by expressions."""
    items = as_list(order_by)
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(items)
    if not items or any(isinstance(i, Column) for i in items) or len(asc) != len(items):
        return None
    return tuple((i, bool(a)) for i, a in zip(items, asc))


def positions_of(df: DataFrame, order_by=None, ascending=True) -> Positions | None:
    """The positions kept beside ``df``, if they follow this order."""
    known = df.__dict__.get("_tw_positions")
    return known if known is not None and known.key == order_key(order_by, ascending) else None


def keep_positions(df: DataFrame, known: Positions | None) -> DataFrame:
    if known is not None and known.key is not None:
        df._tw_positions = known
    return df


def follow(before: DataFrame, change: Callable[[DataFrame], DataFrame], changed) -> DataFrame:
    """``change(before)``, with the positions of ``before`` where ``change`` works on single rows
    and alters only the columns ``changed``, none of them a column of the order."""
    known = before.__dict__.get("_tw_positions")
    out = change(before)
    if known is not None and not known.columns() & set(changed):
        keep_positions(out, Positions(known.key, lambda lo, hi: change(known.rows(lo, hi)), known.total))
    return out


def positioned(df: DataFrame, order_by, ascending=True) -> Positions:
    """The positions kept beside ``df``, or else those of a sorted and frozen copy."""
    known = positions_of(df, order_by, ascending)
    if known is None:
        spec = order_columns(df, order_by, ascending)
        # equal keys go on by input place, so that a hot key is spread over range partitions too
        tied = df.withColumn("_tw_tie", F.monotonically_increasing_id()).orderBy(*spec, "_tw_tie").drop("_tw_tie")
        known = _frozen_positions(tied, order_key(order_by, ascending))
    return known


def index_table(df: DataFrame, order_by, ascending=True) -> DataFrame:
    """A frozen copy of ``df`` with its positions beside it: positional operators on it, and on what
    slices, positional drops and ordered fills make of it, do not sort again."""
    known = positioned(df, order_by, ascending)
    return keep_positions(known.rows(0, known.total).select(*[col(c) for c in df.columns]), known)


def with_position(df: DataFrame, order_by, ascending=True, name: str = POS,
                  total: str | None = None, keep_partition: bool = False) -> DataFrame:
    """Add the exact 0-based position of every row in ``order_by`` order.

    ``total`` optionally names a column holding the table's row count;
    ``keep_partition`` keeps the 0-based file (block) number as ``PID``.
    """
    return _named(df, positioned(df, order_by, ascending), name, total, keep_partition)


def number_rows(df: DataFrame, name: str = POS, total: str | None = None, keep_partition: bool = False) -> DataFrame:
    """Number the rows of a sorted table (0-based) in the order they are in."""
    return _named(df, _frozen_positions(df, None), name, total, keep_partition)


def _named(df: DataFrame, known: Positions, name: str, total: str | None, keep_partition: bool) -> DataFrame:
    extra = [F.lit(known.total).cast("long").alias(total)] if total else []
    return known.rows(0, known.total).select(
        *[col(c) for c in df.columns], F.col(POS).alias(name), *extra, *([F.col(PID)] if keep_partition else []))


def _frozen_positions(df: DataFrame, key: tuple | None) -> Positions:
    """Write a sorted table; the row counts of its files are the index."""
    spark, path = df.sparkSession, scratch_table_path(df, "order")
    df.write.mode("overwrite").parquet(path)
    ordered = spark.read.parquet(path)
    fname = F.col("_metadata.file_name")
    counts = sorted(((r[0], r[1]) for r in ordered.groupBy(fname.alias("f")).count().collect()),
                    key=lambda fc: _file_order(fc[0]))
    files, acc = [], 0
    for i, (f, n) in enumerate(counts):
        files.append((f, acc, i, n))
        acc += n

    def rows(lo: int, hi: int) -> DataFrame:
        wanted = [f for f in files if f[1] < hi and f[1] + f[3] > lo]
        table = ordered
        if len(wanted) < len(files):  # the others are not opened
            table = spark.read.schema(ordered.schema).parquet(*[f"{path}/{f[0]}" for f in wanted or files[:1]])
        # one row per file; Spark decides from its size how to join it
        offs = spark.createDataFrame([f[:3] for f in wanted], "_tw_f string, _tw_off long, _tw_fi int")
        tagged = table.select(F.col("*"), fname.alias("_tw_fn"), F.col("_metadata.row_index").alias("_tw_ri"))
        joined = tagged.join(offs, F.col("_tw_fn") == F.col("_tw_f"))
        return joined.select(*[col(c) for c in df.columns], (F.col("_tw_off") + F.col("_tw_ri")).alias(POS),
                             F.col("_tw_fi").alias(PID))

    return Positions(key, rows, acc)


def carry(df: DataFrame, order_by, forward: dict[str, Column] | None = None,
          backward: dict[str, Column] | None = None, ascending=True, keep_partition: bool = False) -> DataFrame:
    """Carry the last (``forward``) / next (``backward``) non-null value along the order.

    ``forward`` / ``backward`` map output names to expressions, evaluated
    after positions are assigned (they may use the position column
    ``POS``; use a struct to carry several fields at once).  One sort, one
    shuffle by block for both directions.  Returns ``df`` plus ``POS`` and
    the carried columns.

    Both directions use growing frames (start of block to current row); the
    backward one runs over the reversed order, because a frame that runs
    to the end of the block is recomputed for every row.
    """
    forward, backward = dict(forward or {}), dict(backward or {})
    if not forward and not backward:
        raise OperatorError("nothing to carry")
    pos = with_position(df, order_by, ascending, keep_partition=True)
    fk = {f"_tw_f{i}": e for i, e in enumerate(forward.values())}
    bk = {f"_tw_b{i}": e for i, e in enumerate(backward.values())}
    names = {**dict(zip(fk, forward)), **dict(zip(bk, backward))}
    staged = pos.select("*", *[e.alias(k) for k, e in {**fk, **bk}.items()])
    grow = (Window.unboundedPreceding, 0)
    up = Window.partitionBy(PID).orderBy(F.col(POS).asc()).rowsBetween(*grow)
    down = Window.partitionBy(PID).orderBy(F.col(POS).desc()).rowsBetween(*grow)
    inside = staged.select(
        "*", *[F.last(k, ignorenulls=True).over(up).alias(k + "_loc") for k in fk],
        *[F.last(k, ignorenulls=True).over(down).alias(k + "_loc") for k in bk])
    # per block: its last (first) non-null value -> one row per written file
    edge_aggs = [F.max_by(k, F.when(F.col(k).isNotNull(), F.col(POS))).alias(k) for k in fk]
    edge_aggs += [F.min_by(k, F.when(F.col(k).isNotNull(), F.col(POS))).alias(k) for k in bk]
    edges = staged.groupBy(PID).agg(*edge_aggs)
    before = Window.orderBy(F.col(PID).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col(PID).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried_in = edges.select(
        PID, *[F.last(k, ignorenulls=True).over(before).alias(k + "_in") for k in fk],
        *[F.last(k, ignorenulls=True).over(after).alias(k + "_in") for k in bk])
    joined = inside.join(carried_in, PID)
    return joined.select(
        *[col(c) for c in df.columns], F.col(POS), *([F.col(PID)] if keep_partition else []),
        *[F.coalesce(F.col(k + "_loc"), F.col(k + "_in")).alias(names[k]) for k in {**fk, **bk}])


def run_starts(pos: DataFrame, keys: list[str], pos_col: str, prefix: str) -> DataFrame:
    """Start position and length of each run of equal ``keys`` in a positioned table.

    ``pos`` must come from ``with_position(..., keep_partition=True)`` sorted
    with ``keys`` leading.  Runs are summarised per (file, key) first and
    joined back on (file, key): a run holding a third of all rows spans many
    sorted files, so no join partition holds it whole.  Adds
    ``{prefix}_start`` and ``{prefix}_size``.
    """
    kn = [f"{prefix}_k{i}" for i in range(len(keys))]
    per_file = pos.groupBy(F.col(PID), *[col(b).alias(k) for b, k in zip(keys, kn)]).agg(
        F.min(pos_col).alias(f"{prefix}_fs"), F.count(F.lit(1)).alias(f"{prefix}_fc"))
    # one row per (file, key): the run's start and length over all files
    whole = Window.partitionBy(*[F.col(k) for k in kn])
    starts = per_file.select(
        F.col(PID).alias(f"{prefix}_p"), *[F.col(k) for k in kn],
        F.min(f"{prefix}_fs").over(whole).alias(f"{prefix}_start"),
        F.sum(f"{prefix}_fc").over(whole).alias(f"{prefix}_size"))
    cond = F.col(PID) == F.col(f"{prefix}_p")
    for b, k in zip(keys, kn):
        cond = cond & col(b).eqNullSafe(F.col(k))
    return pos.join(starts, cond).drop(f"{prefix}_p", *kn)


def group_rank(df: DataFrame, by, order_by, ascending=True, name: str = "_tw_rank",
               size: str | None = None) -> DataFrame:
    """0-based rank of each row inside its group of ``by``, skew-proof.

    One global sort on (by, order) gives positions; a group's start is its
    smallest position (``run_starts``).  ``size`` optionally adds the
    group's row count.
    """
    by = require_columns(df, by)
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(as_list(order_by))
    keys = [col(b).asc_nulls_last() for b in by] + order_columns(df, order_by, asc)
    pos = with_position(df, keys, name="_tw_gpos", keep_partition=True)
    joined = run_starts(pos, by, "_tw_gpos", "_tw_g")
    return joined.select(
        *[col(c) for c in df.columns], (F.col("_tw_gpos") - F.col("_tw_g_start")).alias(name),
        *([F.col("_tw_g_size").alias(size)] if size else []))
