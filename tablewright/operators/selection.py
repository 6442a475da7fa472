"""Projections, filters, sorts, limits, top-k and sampling.

PRJ-1..7, FLT-1..5, FLT-10..14, SRT-1..2, LIM-1..5, TOP-1..2, SMP-1..5.
"""

from __future__ import annotations

import datetime as _dt
import decimal as _dec
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..order import PID, POS, Positions, group_rank, keep_positions, order_columns, positioned, with_position
from ..schema import OperatorError, as_list, col, family, require_batch, require_columns

DTYPE_FAMILIES = {"number", "bool", "datetime", "object"}
# Fixed value: result rows handed to a caller at most (LIM-5).
MAX_RESULT_ROWS = 100_000


def first_n(df: DataFrame, sort_cols: list, n: int, offset: int = 0) -> DataFrame:
    """Rows [offset, offset + n) of ``df`` in ``sort_cols`` order (Spark's own top-k)."""
    ordered = df.orderBy(*sort_cols)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def _match_names(df: DataFrame, names, case_insensitive: bool) -> list[str]:
    out = []
    for n in as_list(names):
        if n in df.columns:
            out.append(n)
            continue
        if case_insensitive:
            hits = [c for c in df.columns if c.lower() == str(n).lower()]
            if len(hits) == 1:
                out.append(hits[0])
                continue
            if len(hits) > 1:
                raise OperatorError(f"Column name '{n}' is ambiguous: {', '.join(hits)}")
        raise OperatorError(f"Column(s) not found: {n}; available: {', '.join(df.columns)}")
    return out


def select_columns(df: DataFrame, columns=None, keep: bool = True, pattern: str | None = None,
                   dtypes=None, case_insensitive: bool = False) -> DataFrame:
    """PRJ-1..4: union of names, regex search and dtype families, in table order."""
    chosen: set[str] = set(_match_names(df, columns, case_insensitive))
    if pattern:
        rx = re.compile(pattern, re.IGNORECASE if case_insensitive else 0)
        chosen |= {c for c in df.columns if rx.search(c)}
    fams = {d.lower() for d in as_list(dtypes)}
    unknown = fams - DTYPE_FAMILIES
    if unknown:
        raise OperatorError(f"Unknown dtype family: {', '.join(sorted(unknown))}")
    if fams:
        chosen |= {f.name for f in df.schema.fields if family(f.dataType) in fams}
    if not columns and not pattern and not fams:
        raise OperatorError("Give columns, a pattern or dtypes")
    if keep:
        picked = [c for c in df.columns if c in chosen]
        if not picked:
            raise OperatorError("No columns matched")
        return df.select(*[col(c) for c in picked])
    return df.drop(*[c for c in df.columns if c in chosen])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ-5 with the three checks: unknown old, duplicate new, clash."""
    if not mapping:
        raise OperatorError("Rename mapping cannot be empty")
    require_columns(df, mapping.keys())
    new = list(mapping.values())
    if len(set(new)) != len(new):
        raise OperatorError("New column names must be unique")
    untouched = set(df.columns) - set(mapping)
    clash = [n for n in new if n in untouched]
    if clash:
        raise OperatorError(f"New names clash with existing columns: {', '.join(clash)}")
    return df.withColumnsRenamed(mapping)


def reorder_columns(df: DataFrame, columns, case_insensitive: bool = False) -> DataFrame:
    """PRJ-6: listed first, the rest after in their old order."""
    listed = _match_names(df, columns, case_insensitive)
    if len(set(listed)) != len(listed):
        raise OperatorError("Duplicate columns in the new order")
    rest = [c for c in df.columns if c not in listed]
    return df.select(*[col(c) for c in listed + rest])


def set_index(df: DataFrame, columns=None, drop: bool = True, reset: bool = False,
              order_by=None, name: str = "index") -> tuple[DataFrame, list[str]]:
    """PRJ-7: index columns become the leading columns; returns (table, index names).

    ``reset`` with an ``order_by`` adds a 0-based position column instead.
    ``drop=False`` keeps a copy of the key columns as data as well.
    """
    if reset:
        if order_by is None:
            return df, []
        return with_position(df, order_by, name=name).select(
            F.col(name), *[col(c) for c in df.columns]), [name]
    keys = require_columns(df, columns)
    rest = [c for c in df.columns if c not in keys]
    extra = [] if drop else [col(k).alias(f"{k}_data") for k in keys]
    return df.select(*[col(k) for k in keys], *extra, *[col(c) for c in rest]), keys


# -------------------------------------------------------------------- filters

def sql_literal(value) -> str:
    """Render a Python value as a Spark SQL literal (for ``@name`` variables)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, _dec.Decimal)):
        return str(value)
    if isinstance(value, float):
        return repr(value) if value == value else "double('NaN')"
    if isinstance(value, _dt.datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    if isinstance(value, _dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (list, tuple, set, frozenset)):
        return "(" + ", ".join(sql_literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


# Quoted text, quoted names, @variables and words of a predicate.
_TOKENS = re.compile(r"""(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<quoted>`(?:[^`]|``)*`)|@(?P<var>[A-Za-z_][A-Za-z0-9_]*)|(?P<word>(?<![.\w])[^\W\d]\w*)(?P<call>(?=\s*[('".]))?""")


def predicate_text(condition: str, variables: dict | None = None, names: dict[str, str] | None = None) -> str:
    """The predicate with variables as literals and, given ``names`` (column -> name to write), with
    words resolved to columns: the exact name, else the only one equal in letter case aside.

    Quoted text stays as it is; a word that several columns fit, or that is a
    function, a literal's type or part of a dotted name, stays a word.
    """
    folded: dict[str, list[str]] = {}
    for n in names or {}:
        folded.setdefault(n.lower(), []).append(n)

    def found(name: str) -> str | None:
        if name in (names or {}):
            return names[name]
        fits = folded.get(name.lower(), [])
        return names[fits[0]] if len(fits) == 1 else None

    def sub(m):
        if m["var"]:
            if m["var"] not in (variables or {}):
                raise OperatorError(f"Unknown variable @{m['var']}")
            return sql_literal(variables[m["var"]])
        if m["quoted"]:
            to = found(m["quoted"][1:-1].replace("``", "`"))
            return "`" + to.replace("`", "``") + "`" if to else m[0]
        if m["word"] and m["call"] is None and m["word"].upper() not in _KEYWORDS:
            to = found(m["word"])
            return "`" + to.replace("`", "``") + "`" if to else m[0]
        return m[0]

    return _TOKENS.sub(sub, condition)


# Words of predicates that are never columns.
_KEYWORDS = {"AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "RLIKE", "BETWEEN", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END",
             "DISTINCT", "FROM", "ESCAPE", "DIV", "AS", "INTERVAL"}


def predicate(condition, variables: dict | None = None, names: dict[str, str] | None = None) -> Column:
    """A Spark SQL predicate string (``@name`` = variable) or a Column."""
    if isinstance(condition, Column):
        return condition
    if not isinstance(condition, str) or not condition.strip():
        raise OperatorError("condition must be a non-empty SQL predicate or a Column")
    text = predicate_text(condition, variables, names)
    try:
        return F.expr(text)
    except Exception as e:  # parse errors surface here, before any job
        raise OperatorError(f"Invalid condition: {condition}: {e}") from e


def filter_rows(df: DataFrame, condition, variables: dict | None = None,
                use_query: bool = True) -> DataFrame:
    """FLT-1..4: keep rows where the predicate is true (NULL counts as false).

    Column names are exact, or fit one column in letter case aside, whatever the
    session's case rule; columns that differ in case only keep apart.
    ``use_query`` (FLT-2: evaluate to a mask, then index) selects the same
    rows; it is accepted for signature parity and has no effect.
    """
    if isinstance(condition, str) and len({c.lower() for c in df.columns}) < len(df.columns):
        # Spark's case rule cannot tell such columns apart: they go by place
        places = {c: f"_tw_{i}" for i, c in enumerate(df.columns)}
        if len(places) < len(df.columns):
            raise OperatorError("two columns have the same name")
        byplace = df.toDF(*places.values())
        out = byplace.filter(predicate(condition, variables, places)).toDF(*df.columns)
    else:
        out = df.filter(predicate(condition, variables, {c: c for c in df.columns}))
    out.schema  # analysis now: unknown columns fail at call time
    return out


def ne_keep_null(column: str | Column, value) -> Column:
    """FLT-5: ``column != value`` that is true for NULL, as in pandas."""
    c = col(column) if isinstance(column, str) else column
    return ~c.eqNullSafe(F.lit(value))


def search_all_columns(df: DataFrame, text: str) -> DataFrame:
    """FLT-10: row kept if the lower-cased, space-joined row contains ``text``.

    NULL cells are left out of the joined text (pandas would write ``nan``).
    """
    joined = F.lower(F.concat_ws(" ", *[col(c).cast("string") for c in df.columns]))
    return df.filter(F.instr(joined, text.lower()) > 0)


def range_predicate(column: str, low=None, high=None) -> Column:
    """FLT-11: inclusive range; NULL never matches."""
    c = col(column)
    preds = []
    if low is not None:
        preds.append(c >= F.lit(low))
    if high is not None:
        preds.append(c <= F.lit(high))
    return reduce(and_, preds) if preds else c.isNotNull()


def isin_predicate(column: str, values) -> Column | None:
    """FLT-12: value set on the text form of the column; empty set = no filter."""
    vals = [str(v) for v in as_list(values)]
    if not vals:
        return None
    return col(column).cast("string").isin(vals)


def filter_combined(df: DataFrame, search: str | None = None, ranges: dict | None = None,
                    values: dict | None = None) -> DataFrame:
    """FLT-13: AND of the explorer filters (search, ranges, value sets)."""
    preds: list[Column] = []
    for c, (lo, hi) in (ranges or {}).items():
        require_columns(df, [c])
        preds.append(range_predicate(c, lo, hi))
    for c, vals in (values or {}).items():
        require_columns(df, [c])
        p = isin_predicate(c, vals)
        if p is not None:
            preds.append(p)
    out = df.filter(reduce(and_, preds)) if preds else df
    if search:
        out = search_all_columns(out, search)
    return out


# ---------------------------------------------------------------------- sorts

def sort_data(df: DataFrame, by, ascending=True, na_position: str = "last") -> DataFrame:
    """SRT-1: per-column direction; nulls first or last whatever the direction."""
    by = require_columns(df, by)
    if isinstance(ascending, (list, tuple)) and len(ascending) != len(by):
        raise OperatorError("Length of ascending must match the number of sort columns")
    if na_position not in ("first", "last"):
        raise OperatorError("na_position must be 'first' or 'last'")
    return df.orderBy(*order_columns(df, by, ascending, nulls_last=na_position == "last"))


# --------------------------------------------------------------- limits, top-k

def head_rows(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """LIM-1: first n rows in ``order_by`` order (top-k plan, no full sort)."""
    if n <= 0:
        raise OperatorError("n must be positive")
    if order_by is None:
        return df.limit(n)
    return first_n(df, order_columns(df, order_by), n)


def tail_rows(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """LIM-2: last n rows, returned in ascending order."""
    if n <= 0:
        raise OperatorError("n must be positive")
    if order_by is None:
        raise OperatorError("tail_rows needs order_by: a table has no last row otherwise")
    last = first_n(df, order_columns(df, order_by, ascending=False, nulls_last=False), n)
    return last.orderBy(*order_columns(last, order_by))


def slice_rows(df: DataFrame, start: int | None = 0, end: int | None = None,
               step: int | None = None, order_by=None, position: str | None = None) -> DataFrame:
    """LIM-3: ``[start:end:step]`` over the rows in ``order_by`` order.

    Negative bounds count from the end as in Python; the row count comes
    from the position pass, so no separate count job runs, and only files
    that hold positions of the slice are read.
    """
    require_batch(df, "slice_rows")
    step = 1 if step is None else step
    if step == 0:
        raise OperatorError("slice step cannot be zero")
    known = positioned(df, order_by)
    lo, hi, _ = slice(start, end, step).indices(known.total)
    picked = range(lo, hi, step)
    first, last = (min(picked[0], picked[-1]), max(picked[0], picked[-1])) if picked else (0, -1)
    p = F.col(POS)
    cond = (p >= first) & (p <= last) & (F.pmod(p - first, F.lit(abs(step))) == 0)
    keep = [col(c) for c in df.columns] + ([p.alias(position)] if position else [])

    def rows(a: int, b: int) -> DataFrame:
        part = known.rows(first + a * step, min(first + (b - 1) * step, last) + 1).filter(cond)
        return part.select(*keep, ((p - first) / F.lit(step)).cast("long").alias(POS), PID)

    out = known.rows(first, last + 1).filter(cond).select(*keep)
    # rows taken backwards do not follow the order any more
    return keep_positions(out, Positions(known.key, rows, len(picked))) if step > 0 and position not in df.columns else out


def page(df: DataFrame, page_number: int, page_size: int, order_by) -> DataFrame:
    """LIM-4: one page of a sorted view (sorted top-k with an offset)."""
    if page_number < 1 or page_size < 1:
        raise OperatorError("page and page size start at 1")
    return first_n(df, order_columns(df, order_by), page_size, (page_number - 1) * page_size)


def cap_rows(df: DataFrame, limit: int = MAX_RESULT_ROWS) -> DataFrame:
    """LIM-5: cap rows only when handing a result to a caller."""
    return df.limit(limit)


def nlargest(df: DataFrame, n: int, column: str, tie_break=None) -> DataFrame:
    """TOP-1: n rows with the largest value; ``tie_break`` orders equal values."""
    require_columns(df, [column])
    keys = [col(column).desc()] + (order_columns(df, tie_break) if tie_break else [])
    return first_n(df.filter(col(column).isNotNull()), keys, n)


def nsmallest(df: DataFrame, n: int, column: str, tie_break=None) -> DataFrame:
    require_columns(df, [column])
    keys = [col(column).asc()] + (order_columns(df, tie_break) if tie_break else [])
    return first_n(df.filter(col(column).isNotNull()), keys, n)


# ------------------------------------------------------------------- sampling

def sample_key(key_cols, seed) -> Column:
    """Reproducible pseudo-random sort key from the row key and the seed.

    Independent of partitioning (unlike ``rand``); the same text is hashed
    by any engine with ``md5``.
    """
    parts = [col(k).cast("string") for k in as_list(key_cols)] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def smallest_by_hash(df: DataFrame, h: Column, key: list[str], n: int | None = None,
                     frac: float | None = None) -> DataFrame:
    """The n (or round(frac * rows)) rows with the smallest ``(h, key)``.

    ``h`` is a uniform hex hash (md5 text).  One aggregate counts rows per
    4-hex-digit prefix (at most 65 536 buckets to the driver); buckets below
    the one where the count is reached are kept whole, and only the rows of
    that one bucket are ranked.  Same rows as sorting the whole table, without
    sorting it.
    """
    bucket = F.substring(h, 1, 4)
    hist = sorted((r[0], r[1]) for r in df.groupBy(bucket.alias("_tw_b")).count().collect())
    total = sum(c for _, c in hist)
    want = round_half_even(frac * total) if frac is not None else n
    cum, cut, rest = 0, None, 0
    for b, c in hist:
        if cum + c <= want:
            cum += c
            continue
        cut, rest = b, want - cum
        break
    if want > total:
        raise OperatorError(f"cannot draw {want} rows from {total}")
    if cut is None:
        return df
    whole = df.filter(bucket < F.lit(cut))
    if rest == 0:
        return whole
    edge = first_n(df.filter(bucket == F.lit(cut)), [h, *[col(k) for k in key]], rest)
    return whole.unionByName(edge)


def round_half_even(x: float) -> int:
    return int(round(x))


def sample_rows(df: DataFrame, n: int | None = None, frac: float | None = None,
                random_state: int | None = None, by: str | None = None, replace: bool = False,
                key=None) -> DataFrame:
    """SMP-1..5: exact-size reproducible samples.

    Rows are ranked by ``md5(key|seed)`` (``key`` = a unique column list),
    then the first n (or ``round(frac * count)``) are kept, per ``by`` group
    when given.  With ``replace``, n draws are made with a seeded position
    per draw and joined back on the row position.
    """
    require_batch(df, "sample_rows")
    if n is not None and frac is not None:
        raise OperatorError("Give either n or frac, not both")
    if frac is not None and not (0 < frac <= 1) and not replace:
        raise OperatorError("frac must be in (0, 1]")
    if n is None and frac is None:
        n = 1
    if n is not None and n <= 0:
        raise OperatorError("n must be positive")
    seed = 0 if random_state is None else random_state
    key = as_list(key) or list(df.columns)
    require_columns(df, key)
    h = sample_key(key, seed)
    if replace:
        return _sample_with_replacement(df, n, frac, seed, key, by)
    if by is None:
        # hash-prefix counts, no sort of the table
        hashed = df.withColumn("_tw_h", h)
        out = smallest_by_hash(hashed, F.col("_tw_h"), key, n=n, frac=frac)
        return out.select(*[col(c) for c in df.columns])
    require_columns(df, [by])
    base = df.filter(col(by).isNotNull()).withColumn("_tw_h", h)
    return _stratified_by_hash(base, by, key, n, frac).select(*[col(c) for c in df.columns])


def _stratified_by_hash(base: DataFrame, by: str, key: list[str], n: int | None,
                        frac: float | None) -> DataFrame:
    """Per group, the n (or round(frac * size)) rows with the smallest (hash, key).

    Rows are counted per (group, 4-hex-digit hash prefix); a window over that
    histogram (at most 65 536 rows per group) finds each group's cut-off
    bucket; buckets below it are kept whole and only the rows of the cut-off
    bucket are ranked (a window over one slice).  A group holding a third of
    all rows is thus spread over up to 65 536 slices; nothing is sorted whole.
    """
    b = F.substring(F.col("_tw_h"), 1, 4)
    hb = base.withColumn("_tw_b", b)
    hist = hb.groupBy(col(by).alias("_tw_g"), F.col("_tw_b").alias("_tw_bk")).agg(
        F.count(F.lit(1)).alias("_tw_c"))
    grp = Window.partitionBy("_tw_g")
    before = F.coalesce(F.sum("_tw_c").over(grp.orderBy("_tw_bk").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    size = F.sum("_tw_c").over(grp)
    want = F.lit(n).cast("long") if n is not None else F.bround(size * F.lit(frac), 0).cast("long")
    hist = hist.select("*", before.alias("_tw_before"), size.alias("_tw_size"), want.alias("_tw_want"))
    if n is not None:  # a group smaller than n is an error, raised by the job itself
        hist = hist.filter(F.when(F.col("_tw_size") < F.lit(n), F.raise_error(
            F.lit(f"a group of '{by}' has fewer than {n} rows")).cast("boolean")).otherwise(F.lit(True)))
    needed = hist.filter(F.col("_tw_before") < F.col("_tw_want"))
    j = hb.join(needed, (col(by) == F.col("_tw_g")) & (F.col("_tw_b") == F.col("_tw_bk")))
    whole = j.filter(F.col("_tw_before") + F.col("_tw_c") <= F.col("_tw_want"))
    edge = j.filter(F.col("_tw_before") + F.col("_tw_c") > F.col("_tw_want"))
    slice_w = Window.partitionBy("_tw_g", "_tw_bk").orderBy(F.col("_tw_h"), *[col(k) for k in key])
    edge = edge.withColumn("_tw_rn", F.row_number().over(slice_w)).filter(
        F.col("_tw_rn") <= F.col("_tw_want") - F.col("_tw_before")).drop("_tw_rn")
    return whole.unionByName(edge)


def _draw(seed, *parts: Column) -> Column:
    """A reproducible number from the draw and the seed: 15 hex digits of their md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _sample_with_replacement(df: DataFrame, n, frac, seed, key, by=None) -> DataFrame:
    """n draws (per ``by`` group), each a seeded position in ``key`` order."""
    spark = df.sparkSession
    if by is not None:
        require_columns(df, [by])
        pos = group_rank(df.filter(col(by).isNotNull()), [by], key, name=POS, size="_tw_n")
        want = F.lit(n) if n is not None else F.bround(F.col("_tw_n") * F.lit(frac), 0).cast("long")
        groups = pos.select(col(by).alias("_tw_g"), "_tw_n").distinct()
        draws = groups.filter(want > 0).select("_tw_g", "_tw_n", F.explode(F.sequence(F.lit(0).cast("long"), want - 1)).alias("_tw_draw"))
        draws = draws.select("_tw_g", F.pmod(_draw(seed, F.col("_tw_g"), F.col("_tw_draw")), F.col("_tw_n")).alias("_tw_p"))
        return pos.join(draws, (col(by) == F.col("_tw_g")) & (F.col(POS) == F.col("_tw_p"))).select(*[col(c) for c in df.columns])
    pos = with_position(df, key, total="_tw_n")
    first = pos.select("_tw_n").limit(1).first()
    total = first[0] if first else 0
    if total == 0:
        raise OperatorError("cannot sample from an empty table")
    if n is None:
        n = round_half_even(frac * total)
    # one seeded uniform position per draw, independent of partitioning
    picks = spark.range(n).select(
        F.col("id").alias("_tw_draw"),
        F.pmod(_draw(seed, F.col("id")), F.lit(total)).alias(POS))
    return pos.join(picks, POS).select(*[col(c) for c in df.columns])
