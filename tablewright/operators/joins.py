"""Joins and stacking (JN-1..9, SET-1..3).

Physical strategy is left to Spark: a side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` is broadcast, and adaptive
execution re-plans from measured shuffle sizes (and splits skewed
partitions of sort-merge joins).  Null keys match each other by default
(``null_equal``), which Spark still plans as an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..order import POS, with_position
from ..schema import OperatorError, as_list, col, dtype_of, require_batch, require_columns

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full",
        "cross": "cross"}


def merge_tables(left: DataFrame, right: DataFrame, how: str = "inner", left_on=None,
                 right_on=None, on=None, suffixes=("_left", "_right"),
                 null_equal: bool = True, salt: int | None = None) -> DataFrame:
    """JN-1..7: equi-join with pandas-style key handling and suffixes.

    ``on`` (or equal left/right names) yields one key column, coalesced
    for outer joins; overlapping non-key columns get the suffixes.

    ``salt=N`` (inner / left joins) spreads the left rows of heavy keys over
    N join partitions: keys holding more than ``1/N`` of the left rows are
    found with one distributed count; their left rows get a salt 0..N-1
    from a hash of the row (stable across task retries) and the matching
    right rows are copied N times.  Other keys join unchanged (salt 0).
    """
    if how not in HOWS:
        raise OperatorError(f"Unsupported join type '{how}'")
    if how == "cross":
        if on or left_on or right_on:
            raise OperatorError("cross join takes no keys")
        return _suffix_cross(left, right, suffixes)
    if on is not None and (left_on is not None or right_on is not None):
        raise OperatorError("Give either on, or left_on and right_on")
    if on is not None:
        lk = rk = as_list(on)
    else:
        lk, rk = as_list(left_on), as_list(right_on)
    if not lk or len(lk) != len(rk):
        raise OperatorError("Join keys are missing or of different length")
    require_columns(left, lk, "Left key")
    require_columns(right, rk, "Right key")
    for a, b in zip(lk, rk):
        if dtype_of(left, a) != dtype_of(right, b):
            raise OperatorError(
                f"Key types differ: {a} {dtype_of(left, a).simpleString()} vs "
                f"{b} {dtype_of(right, b).simpleString()}")
    shared = [a for a, b in zip(lk, rk) if a == b]
    l_alias = {c: f"_tw_l{i}" for i, c in enumerate(left.columns)}
    r_alias = {c: f"_tw_r{i}" for i, c in enumerate(right.columns)}
    L = left.select(*[col(c).alias(l_alias[c]) for c in left.columns])
    R = right.select(*[col(c).alias(r_alias[c]) for c in right.columns])
    conds = []
    for a, b in zip(lk, rk):
        la, rb = F.col(l_alias[a]), F.col(r_alias[b])
        conds.append(la.eqNullSafe(rb) if null_equal else la == rb)
    if salt and salt > 1:
        if HOWS[how] not in ("inner", "left"):
            raise OperatorError("salt is for inner and left joins")
        L, R = _salt_sides(L, R, [l_alias[a] for a in lk], [r_alias[b] for b in rk], salt, null_equal)
        conds.append(F.col("_tw_salt_l") == F.col("_tw_salt_r"))
    joined = L.join(R, reduce(lambda x, y: x & y, conds), HOWS[how])
    right_rest = [c for c in right.columns if c not in shared]
    left_names = set(left.columns) - set(shared)
    overlap = {c for c in right_rest if c in left_names}
    out = []
    for c in left.columns:
        if c in shared:
            out.append(F.coalesce(F.col(l_alias[c]), F.col(r_alias[c])).alias(c)
                       if HOWS[how] in ("full", "right") else F.col(l_alias[c]).alias(c))
        else:
            out.append(F.col(l_alias[c]).alias(c + suffixes[0] if c in overlap else c))
    for c in right_rest:
        out.append(F.col(r_alias[c]).alias(c + suffixes[1] if c in overlap else c))
    return joined.select(*out)


def heavy_keys(df: DataFrame, keys: list[str], share: float, limit: int = 1000) -> list[tuple]:
    """Keys holding more than ``share`` of the rows (one count, a top-k)."""
    total = df.count()
    if total == 0:
        return []
    counts = (df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_tw_c"))
              .filter(F.col("_tw_c") > F.lit(share * total))
              .orderBy(F.col("_tw_c").desc()).limit(limit).collect())
    return [tuple(r[k] for k in keys) for r in counts]


def _salt_sides(L: DataFrame, R: DataFrame, lkeys: list[str], rkeys: list[str], n: int,
                null_equal: bool) -> tuple[DataFrame, DataFrame]:
    hot = heavy_keys(L, lkeys, 1.0 / n)

    def is_hot(cols):
        cond = F.lit(False)
        for key in hot:
            one = F.lit(True)
            for c, v in zip(cols, key):
                one = one & (F.col(c).eqNullSafe(F.lit(v)) if null_equal or v is None else F.col(c) == F.lit(v))
            cond = cond | one
        return cond

    row_hash = F.xxhash64(*[F.col(c) for c in L.columns])
    Ls = L.withColumn("_tw_salt_l", F.when(is_hot(lkeys), F.pmod(row_hash, F.lit(n))).otherwise(F.lit(0)))
    copies = F.when(is_hot(rkeys), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    Rs = R.withColumn("_tw_salt_r", F.explode(copies))
    return Ls, Rs


def _suffix_cross(left: DataFrame, right: DataFrame, suffixes) -> DataFrame:
    """JN-5: explicit cross product (the caller asked for every pair)."""
    overlap = set(left.columns) & set(right.columns)
    L = left.select(*[col(c).alias(c + suffixes[0] if c in overlap else c) for c in left.columns])
    R = right.select(*[col(c).alias(c + suffixes[1] if c in overlap else c) for c in right.columns])
    return L.crossJoin(R)


def merge_on_index(left: DataFrame, right: DataFrame, how: str = "inner",
                   left_index=None, right_index=None, order_by=None,
                   suffixes=("_left", "_right")) -> DataFrame:
    """JN-8: join on declared index columns, or on row position.

    Without index columns each side needs an ``order_by`` (one spec, or a
    pair ``(left_order, right_order)``); rows are then matched by their
    0-based position, which becomes the key column ``index``.
    """
    if left_index is not None or right_index is not None:
        li, ri = as_list(left_index), as_list(right_index or left_index)
        if [*li] == [*ri]:
            return merge_tables(left, right, how, on=li, suffixes=suffixes)
        return merge_tables(left, right, how, left_on=li, right_on=ri, suffixes=suffixes)
    if order_by is None:
        raise OperatorError("merge_on_index needs index columns or order_by")
    lo, ro = order_by if isinstance(order_by, tuple) and len(order_by) == 2 else (order_by, order_by)
    lp = with_position(left, lo, name="index")
    rp = with_position(right, ro, name="index")
    return merge_tables(lp, rp, how, on="index", suffixes=suffixes)


def concat_tables(tables: list[DataFrame], axis: int = 0, join: str = "outer",
                  ignore_index: bool = False, keys=None, order_by=None,
                  source_column: str = "source") -> DataFrame:
    """SET-1..3 (axis 0) and JN-9 (axis 1).

    Axis 0 stacks tables with identical column names (same order) and
    types; ``keys`` label each row's source.  Axis 1 aligns tables on row
    position (``order_by``: a list with one order per table, or one spec
    - a name or a tuple of names - for all tables).
    """
    if len(tables) < 2:
        raise OperatorError("At least two tables are needed")
    if axis == 0:
        first = tables[0]
        for i, t in enumerate(tables[1:], 1):
            if t.columns != first.columns:
                raise OperatorError(f"Table {i} has different columns or column order")
            for c in first.columns:
                if dtype_of(t, c) != dtype_of(first, c):
                    raise OperatorError(f"Column '{c}' has different types in table {i}")
        if keys is not None:
            ks = as_list(keys)
            if len(ks) != len(tables):
                raise OperatorError("One key per table is needed")
            tables = [t.withColumn(source_column, F.lit(k)) for t, k in zip(tables, ks)]
        return reduce(DataFrame.unionByName, tables)
    if axis != 1:
        raise OperatorError("axis must be 0 or 1")
    if join not in ("outer", "inner"):
        raise OperatorError("join must be 'outer' or 'inner'")
    if order_by is None:
        raise OperatorError("column-wise concat needs order_by to align rows")
    # a list with one entry per table = one order per table; else one spec for all
    if isinstance(order_by, list) and len(order_by) == len(tables):
        orders = list(order_by)
    else:
        orders = [order_by] * len(tables)
    seen: set[str] = set()
    for t in tables:
        dup = seen & set(t.columns)
        if dup:
            raise OperatorError(f"Duplicate column names across tables: {', '.join(sorted(dup))}")
        seen |= set(t.columns)
    for t in tables:
        require_batch(t, "concat_tables(axis=1)")
    positioned = [with_position(t, o, name=f"_tw_p{i}") for i, (t, o) in enumerate(zip(tables, orders))]
    how = "full" if join == "outer" else "inner"
    cur = positioned[0].withColumnRenamed("_tw_p0", POS)
    for i, p in enumerate(positioned[1:], 1):
        p = p.withColumnRenamed(f"_tw_p{i}", "_tw_rp")
        cur = cur.join(p, cur[POS] == p["_tw_rp"], how).select(
            "*", F.coalesce(F.col(POS), F.col("_tw_rp")).alias("_tw_pp")).drop(POS, "_tw_rp") \
            .withColumnRenamed("_tw_pp", POS)
    cols = [c for t in tables for c in t.columns]
    return cur.select(F.col(POS).alias("index"), *[col(c) for c in cols])
