"""Registered queries: one Spark callable and one DuckDB oracle per key.

Every query reads the driver's Parquet tables (whole tables, no id subsets
or row caps) and runs through the library's operators.  The oracle is the
same result written as plain SQL over the same files; computed columns
carry the same alias on both sides.  Floating aggregates are rounded (or
summed as decimals) on both sides, because summation order differs between
engines.

``events_n`` is the null-bearing derivation of ``events`` described in
FIXTURES.md: it only blanks some cells and keeps every row.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import analytics as W
from ..operators import charts as C
from ..operators import cleaning as K
from ..operators import joins as J
from ..operators import selection as S
from ..operators import transform as X
from ..order import with_position

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


EVENTS_N_SQL = """(SELECT event_id, ts, user_id,
        CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
        CASE WHEN event_id % 7 <> 0 THEN value END AS value
   FROM events)"""


def events_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with NULLs put in by rule (every row kept)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


def money(c: str) -> F.Column:
    """Exact sum of a money expression: decimal accumulation, double result."""
    return F.sum(F.expr(c).cast("decimal(20,4)")).cast("double")


# =====================================================================
# flagship: scan -> filter -> 3 joins -> partial/final aggregate -> top-k
# =====================================================================

FLAGSHIP_SQL = """
SELECT n_name, l_returnflag,
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DOUBLE) AS revenue,
       count(*) AS line_count
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
GROUP BY n_name, l_returnflag
ORDER BY revenue DESC, n_name, l_returnflag
LIMIT 10
"""


def revenue_by_nation_flag(tables: dict[str, DataFrame], start: str = "1996-01-01",
                           end: str = "1998-01-01", k: int = 10) -> DataFrame:
    """Revenue per (nation, return flag) for lines shipped in [start, end), top k."""
    li = S.filter_rows(tables["lineitem"], "l_shipdate >= @start AND l_shipdate < @end",
                       {"start": _ts(start), "end": _ts(end)})
    li = S.select_columns(li, ["l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"])
    orders = S.select_columns(tables["orders"], ["o_orderkey", "o_custkey"])
    cust = S.select_columns(tables["customer"], ["c_custkey", "c_nationkey"])
    nation = S.select_columns(tables["nation"], ["n_nationkey", "n_name"])
    j = J.merge_tables(li, orders, left_on="l_orderkey", right_on="o_orderkey", null_equal=False)
    j = J.merge_tables(j, cust, left_on="o_custkey", right_on="c_custkey", null_equal=False)
    j = J.merge_tables(j, nation, left_on="c_nationkey", right_on="n_nationkey", null_equal=False)
    agg = j.groupBy("n_name", "l_returnflag").agg(
        money("l_extendedprice * (1 - l_discount)").alias("revenue"),
        F.count(F.lit(1)).alias("line_count"))
    return agg.orderBy(F.col("revenue").desc(), "n_name", "l_returnflag").limit(k)


def _ts(s: str):
    import datetime as dt
    return dt.datetime.fromisoformat(s)


@register("revenue_by_nation_flag", FLAGSHIP_SQL)
def q_flagship(spark, d):
    names = ["lineitem", "orders", "customer", "nation"]
    return revenue_by_nation_flag({n: table(spark, d, n) for n in names})


# =====================================================================
# PRJ
# =====================================================================

@register("select_keep", "SELECT o_orderkey, o_totalprice FROM orders")
def q_select_keep(spark, d):
    return S.select_columns(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"])


@register("select_drop", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def q_select_drop(spark, d):
    return S.select_columns(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], keep=False)


@register("select_regex", "SELECT l_extendedprice, l_shipdate FROM lineitem")
def q_select_regex(spark, d):
    return S.select_columns(table(spark, d, "lineitem"), pattern=r"(?i)PRICE|date$")


@register("select_dtype", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_select_dtype(spark, d):
    return S.select_columns(table(spark, d, "orders"), dtypes=["number"])


@register("rename_columns", """
SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice AS total,
       o_orderdate, o_orderpriority FROM orders""")
def q_rename(spark, d):
    return S.rename_columns(table(spark, d, "orders"), {"o_orderkey": "order_id", "o_totalprice": "total"})


@register("reorder_columns", """
SELECT o_orderdate, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def q_reorder(spark, d):
    return S.reorder_columns(table(spark, d, "orders"), ["O_ORDERDATE", "o_orderkey"], case_insensitive=True)


@register("set_index", """
SELECT o_custkey, o_custkey AS o_custkey_data, o_orderkey, o_orderstatus, o_totalprice,
       o_orderdate, o_orderpriority FROM orders""")
def q_set_index(spark, d):
    return S.set_index(table(spark, d, "orders"), ["o_custkey"], drop=False)[0]


# =====================================================================
# FLT
# =====================================================================

@register("filter_expr", """
SELECT * FROM lineitem
WHERE l_quantity > 45 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R')""")
def q_filter_expr(spark, d):
    return S.filter_rows(table(spark, d, "lineitem"),
                         "l_quantity > 45 and l_discount >= 0.05 and l_returnflag in ('A', 'R')")


@register("filter_vars", """
SELECT * FROM orders WHERE o_totalprice > 300000.0 AND o_orderpriority = '1-URGENT'""")
def q_filter_vars(spark, d):
    return S.filter_rows(table(spark, d, "orders"), "o_totalprice > @min_price and o_orderpriority = @prio",
                         {"min_price": 300000.0, "prio": "1-URGENT"})


@register("filter_ne_null", f"SELECT * FROM {EVENTS_N_SQL} WHERE event_type IS DISTINCT FROM 'click'")
def q_filter_ne_null(spark, d):
    return S.filter_rows(events_n(spark, d), S.ne_keep_null("event_type", "click"))


@register("drop_rows_condition", f"SELECT * FROM {EVENTS_N_SQL} WHERE NOT coalesce(value > 250, false)")
def q_drop_rows_condition(spark, d):
    return K.drop_rows(events_n(spark, d), condition="value > 250")


@register("drop_rows_positions", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
WHERE pos NOT IN (0, 1) AND pos <> n - 1""")
def q_drop_rows_positions(spark, d):
    return K.drop_rows(table(spark, d, "orders"), indices=[0, 1, -1], order_by="o_orderkey")


@register("drop_missing_any",
          f"SELECT * FROM {EVENTS_N_SQL} WHERE event_type IS NOT NULL AND value IS NOT NULL")
def q_drop_missing_any(spark, d):
    return K.drop_missing(events_n(spark, d), how="any")


@register("drop_missing_thresh", f"""
SELECT * FROM {EVENTS_N_SQL}
WHERE 3 + CAST(event_type IS NOT NULL AS INT) + CAST(value IS NOT NULL AS INT) >= 4""")
def q_drop_missing_thresh(spark, d):
    return K.drop_missing(events_n(spark, d), thresh=4)


@register("drop_missing_cols", f"SELECT event_id, ts, user_id FROM {EVENTS_N_SQL}")
def q_drop_missing_cols(spark, d):
    return K.drop_missing(events_n(spark, d), how="any", axis=1)


@register("search_all_columns", """
SELECT * FROM orders
WHERE instr(lower(concat_ws(' ', o_orderstatus, o_orderpriority)), 'urgent') > 0""")
def q_search(spark, d):
    return S.search_all_columns(table(spark, d, "orders"), "URGENT")


@register("filter_range", "SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def q_filter_range(spark, d):
    o = table(spark, d, "orders")
    return o.filter(S.range_predicate("o_totalprice", 100000, 200000))


@register("filter_isin", "SELECT * FROM part WHERE CAST(p_size AS VARCHAR) IN ('1', '5', '10')")
def q_filter_isin(spark, d):
    p = table(spark, d, "part")
    return p.filter(S.isin_predicate("p_size", [1, 5, 10]))


@register("filter_compound", """
SELECT * FROM part
WHERE p_retailprice BETWEEN 920 AND 980
  AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#25')
  AND instr(lower(concat_ws(' ', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type,
                            CAST(p_size AS VARCHAR))), 'widget') > 0""")
def q_filter_compound(spark, d):
    p = table(spark, d, "part").drop("p_retailprice")
    full = table(spark, d, "part")
    # search covers every column except the double (text of doubles differs between engines)
    kept = S.filter_combined(full, ranges={"p_retailprice": (920, 980)},
                             values={"p_brand": ["Brand#1", "Brand#12", "Brand#25"]})
    hits = S.search_all_columns(kept.select(*p.columns), "Widget")
    return kept.join(hits.select("p_partkey"), "p_partkey", "left_semi")


# =====================================================================
# JN
# =====================================================================

@register("join_inner", """
SELECT * FROM customer JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey""")
def q_join_inner(spark, d):
    return J.merge_tables(table(spark, d, "customer"), table(spark, d, "orders"),
                          left_on="c_custkey", right_on="o_custkey")


@register("join_left", """
SELECT c.*, o.* FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o
  ON c_custkey IS NOT DISTINCT FROM o_custkey""")
def q_join_left(spark, d):
    o = S.filter_rows(table(spark, d, "orders"), "o_orderstatus = 'F'")
    return J.merge_tables(table(spark, d, "customer"), o, "left", left_on="c_custkey", right_on="o_custkey")


@register("join_right", """
SELECT o.*, c.* FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o
RIGHT JOIN customer c ON o_custkey IS NOT DISTINCT FROM c_custkey""")
def q_join_right(spark, d):
    o = S.filter_rows(table(spark, d, "orders"), "o_orderpriority = '1-URGENT'")
    return J.merge_tables(o, table(spark, d, "customer"), "right", left_on="o_custkey", right_on="c_custkey")


@register("join_full", """
SELECT o.*, c.* FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o
FULL OUTER JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c
  ON o_custkey IS NOT DISTINCT FROM c_custkey""")
def q_join_full(spark, d):
    o = S.filter_rows(table(spark, d, "orders"), "o_orderstatus = 'F'")
    c = S.filter_rows(table(spark, d, "customer"), "c_mktsegment = 'BUILDING'")
    return J.merge_tables(o, c, "outer", left_on="o_custkey", right_on="c_custkey")


@register("join_null_keys", f"""
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, g.type_rows
FROM {EVENTS_N_SQL} e
JOIN (SELECT event_type, count(*) AS type_rows FROM {EVENTS_N_SQL} GROUP BY event_type) g
  ON e.event_type IS NOT DISTINCT FROM g.event_type""")
def q_join_null_keys(spark, d):
    e = events_n(spark, d)
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("type_rows"))
    return J.merge_tables(e, g, on="event_type")


@register("join_salted", """
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props, g.type_rows, g.type_mean
FROM events e
JOIN (SELECT event_type, count(*) AS type_rows, round(avg(value), 6) AS type_mean
      FROM events GROUP BY event_type) g
  ON e.event_type IS NOT DISTINCT FROM g.event_type""")
def q_join_salted(spark, d):
    """Every event type holds ~20 % of the rows: all keys are heavy for salt=8."""
    e = table(spark, d, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("type_rows"),
                                    F.round(F.avg("value"), 6).alias("type_mean"))
    return J.merge_tables(e, g, on="event_type", salt=8)


@register("join_suffixes", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice AS o_totalprice_left,
       o.o_orderdate, o.o_orderpriority, l.o_totalprice AS o_totalprice_right, l.lines
FROM orders o JOIN (
  SELECT l_orderkey AS o_orderkey,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS o_totalprice,
         count(*) AS lines
  FROM lineitem GROUP BY l_orderkey) l
ON o.o_orderkey = l.o_orderkey""")
def q_join_suffixes(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        money("l_extendedprice").alias("o_totalprice"), F.count(F.lit(1)).alias("lines"))
    return J.merge_tables(table(spark, d, "orders"), li, on="o_orderkey")


@register("join_on_index", """
SELECT c.pos AS "index", c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       s_suppkey, s_name, s_nationkey, s_acctbal
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) c
LEFT JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) s
ON c.pos = s.pos""")
def q_join_on_index(spark, d):
    return J.merge_on_index(table(spark, d, "customer"), table(spark, d, "supplier"), "left",
                            order_by=("c_custkey", "s_suppkey"))


@register("concat_columns", """
SELECT coalesce(c.pos, s.pos) AS "index", c_custkey, c_name, s_suppkey, s_name
FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) c
FULL OUTER JOIN (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) s
ON c.pos = s.pos""")
def q_concat_columns(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return J.concat_tables([c, s], axis=1, join="outer", order_by=["c_custkey", "s_suppkey"])


# =====================================================================
# SRT / LIM / TOP / SMP  (order-sensitive results carry their position)
# =====================================================================

@register("sort_multi", """
SELECT *, row_number() OVER (ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST,
                                      o_orderkey ASC NULLS LAST) - 1 AS pos
FROM orders""")
def q_sort_multi(spark, d):
    o = table(spark, d, "orders")
    from ..order import number_rows
    return number_rows(S.sort_data(o, ["o_orderpriority", "o_totalprice", "o_orderkey"], [True, False, True]), "pos")


@register("head_rows", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10")
def q_head(spark, d):
    return S.head_rows(table(spark, d, "orders"), 10, order_by=["o_orderdate", "o_orderkey"])


@register("tail_rows", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def q_tail(spark, d):
    return S.tail_rows(table(spark, d, "orders"), 10, order_by=["o_orderdate", "o_orderkey"])


@register("slice_rows", """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
WHERE pos >= 100 AND pos < 400 AND (pos - 100) % 7 = 0""")
def q_slice(spark, d):
    return S.slice_rows(table(spark, d, "orders"), 100, 400, 7, order_by="o_orderkey", position="pos")


@register("slice_rows_negative", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,
                         count(*) OVER () AS n FROM orders)
WHERE pos >= n - 50""")
def q_slice_neg(spark, d):
    return S.slice_rows(table(spark, d, "orders"), -50, None, order_by="o_orderkey")


@register("page", """
SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50""")
def q_page(spark, d):
    return S.page(table(spark, d, "orders"), 3, 25, ["o_totalprice", "o_orderkey"])


@register("nlargest", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_nlargest(spark, d):
    return S.nlargest(table(spark, d, "orders"), 10, "o_totalprice", tie_break="o_orderkey")


@register("nsmallest", "SELECT * FROM part ORDER BY p_retailprice, p_partkey LIMIT 15")
def q_nsmallest(spark, d):
    return S.nsmallest(table(spark, d, "part"), 15, "p_retailprice", tie_break="p_partkey")


@register("filter_top_sort", """
SELECT * FROM (SELECT * FROM orders WHERE o_orderstatus = 'F'
               ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
ORDER BY o_orderdate""")
def q_filter_top_sort(spark, d):
    f = S.filter_rows(table(spark, d, "orders"), "o_orderstatus = 'F'")
    top = S.nlargest(f, 20, "o_totalprice", tie_break="o_orderkey")
    return S.sort_data(top, ["o_orderdate"])


SAMPLE_KEY = "md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42'))"


@register("sample_n", f"SELECT * FROM orders ORDER BY {SAMPLE_KEY}, o_orderkey LIMIT 100")
def q_sample_n(spark, d):
    return S.sample_rows(table(spark, d, "orders"), n=100, random_state=42, key="o_orderkey")


@register("sample_frac", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (ORDER BY {SAMPLE_KEY}, o_orderkey) - 1 AS rn, count(*) OVER () AS n
  FROM orders)
WHERE rn < round_even(0.05 * n, 0)""")
def q_sample_frac(spark, d):
    return S.sample_rows(table(spark, d, "orders"), frac=0.05, random_state=42, key="o_orderkey")


@register("sample_stratified", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {SAMPLE_KEY}, o_orderkey) AS rn
  FROM orders)
WHERE rn <= 20""")
def q_sample_stratified(spark, d):
    return S.sample_rows(table(spark, d, "orders"), n=20, random_state=42, by="o_orderpriority",
                         key="o_orderkey")


@register("sample_stratified_frac", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {SAMPLE_KEY}, o_orderkey) - 1 AS rn,
         count(*) OVER (PARTITION BY o_orderstatus) AS n
  FROM orders)
WHERE rn < round_even(0.02 * n, 0)""")
def q_sample_stratified_frac(spark, d):
    return S.sample_rows(table(spark, d, "orders"), frac=0.02, random_state=42, by="o_orderstatus",
                         key="o_orderkey")


@register("sample_replace", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
d AS (SELECT CAST('0x' || substr(md5(i || '|7'), 1, 15) AS BIGINT) % (SELECT count(*) FROM orders) AS p FROM range(500) t(i))
SELECT o.* EXCLUDE (p) FROM o JOIN d USING (p)""")
def q_sample_replace(spark, d):
    return S.sample_rows(table(spark, d, "orders"), n=500, random_state=7, replace=True, key="o_orderkey")


# =====================================================================
# AGG
# =====================================================================

def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (summation order differs between engines)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


@register("groupby_agg", """
SELECT l_returnflag, sum(l_quantity) AS l_quantity,
       round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
       round(max(l_extendedprice), 6) AS l_extendedprice_max,
       round(stddev_samp(l_discount), 6) AS l_discount
FROM lineitem GROUP BY l_returnflag""")
def q_groupby_agg(spark, d):
    return rounded(A.group_by_agg(table(spark, d, "lineitem"), ["l_returnflag"],
                                  {"l_quantity": "sum", "l_extendedprice": ["mean", "max"],
                                   "l_discount": "std"}))


@register("groupby_multi", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum,
       count(l_quantity) AS l_quantity_count, round(median(l_quantity), 6) AS l_quantity_median,
       min(l_extendedprice) AS l_extendedprice
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_groupby_multi(spark, d):
    return rounded(A.group_by_agg(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"],
                                  {"l_quantity": ["sum", "count", "median"], "l_extendedprice": "min"}))


@register("groupby_null_keys", f"""
SELECT event_type, round(coalesce(sum(value), 0), 2) AS value_sum, count(value) AS value_count,
       count(user_id) AS user_id
FROM {EVENTS_N_SQL} WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_groupby_null_keys(spark, d):
    g = A.group_by_agg(events_n(spark, d), "event_type", {"value": ["sum", "count"], "user_id": "count"})
    return rounded(g, 2)


def _describe_num_sql(t: str, c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, NULL::BIGINT AS \"unique\", "
            f"NULL::VARCHAR AS top, NULL::BIGINT AS freq, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max FROM {t}")


def _describe_text_sql(t: str, c: str) -> str:
    top = (f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} "
           f"ORDER BY count(*) DESC, {c} LIMIT 1)")
    freq = f"(SELECT count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)"
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS \"unique\", "
            f"{top} AS top, {freq} AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, "
            f"NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, "
            f"NULL::DOUBLE AS max FROM {t}")


@register("describe_all", " UNION ALL ".join(
    [_describe_num_sql("part", c) for c in ("p_partkey", "p_size", "p_retailprice")]
    + [_describe_text_sql("part", c) for c in ("p_name", "p_brand", "p_type")]))
def q_describe_all(spark, d):
    return rounded(A.describe_stats(table(spark, d, "part")))


@register("describe_grouped", " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
       FROM lineitem GROUP BY l_returnflag""" for c in ("l_quantity", "l_discount")))
def q_describe_grouped(spark, d):
    return rounded(A.describe_stats(table(spark, d, "lineitem"), group_by="l_returnflag",
                                    columns=["l_quantity", "l_discount"]))


@register("describe_grouped_all", " UNION ALL ".join(
    [f"""SELECT o_orderstatus, 'o_totalprice' AS "column", count(o_totalprice) AS count,
       NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
       round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std,
       round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS p25,
       round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.75), 6) AS p75,
       round(max(o_totalprice), 6) AS max FROM orders GROUP BY o_orderstatus"""]
    + [f"""SELECT o_orderstatus, '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
       arg_min({c}, (-n, {c})) AS top, max(n) AS freq,
       NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25,
       NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max
       FROM (SELECT o_orderstatus, {c}, count(*) AS n FROM orders WHERE {c} IS NOT NULL
             GROUP BY o_orderstatus, {c}) GROUP BY o_orderstatus""" for c in ("o_orderpriority",)]))
def q_describe_grouped_all(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(A.describe_stats(o, group_by="o_orderstatus", include_text=True))


EVENTS_N_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


@register("missing_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
       round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM {EVENTS_N_SQL}"""
    for c in EVENTS_N_COLS))
def q_missing_summary(spark, d):
    return K.missing_counts(events_n(spark, d))


@register("table_summary", f"""
SELECT count(*) AS rows, 5 AS columns, 3 AS numeric_columns, 1 AS categorical_columns,
       1 AS datetime_columns,
       (count(*) - count(event_type)) + (count(*) - count(value)) AS total_missing,
       round(((count(*) - count(event_type)) + (count(*) - count(value))) * 100.0 / (count(*) * 5), 2)
         AS missing_pct,
       CAST(count(*) > count(event_type) AS INT) + CAST(count(*) > count(value) AS INT)
         AS columns_with_missing
FROM {EVENTS_N_SQL}""")
def q_table_summary(spark, d):
    return A.summary_row(events_n(spark, d))


def _profile_sql(t: str, cols: list[tuple[str, str, str]], bounds=(10, 100), skew=False) -> str:
    """cols: (name, spark dtype, kind)."""
    parts = []
    for i, (c, dt, kind) in enumerate(cols):
        nd = f"(SELECT count(DISTINCT {c}) FROM {t})"
        card = (f"CASE WHEN {nd} < {bounds[0]} THEN 'low' WHEN {nd} < {bounds[1]} "
                f"THEN 'medium' ELSE 'high' END")
        if kind == "numeric":
            x = f"CAST({c} AS DOUBLE)"
            num = (f"round(avg({x}), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS median, "
                   f"round(coalesce(stddev_samp({x}), 0), 6) AS std, round(min({x}), 6) AS min, "
                   f"round(max({x}), 6) AS max, round(quantile_cont({x}, 0.25), 6) AS q25, "
                   f"round(quantile_cont({x}, 0.75), 6) AS q75")
            if skew:
                num += (f", round(CASE WHEN count({x}) >= 3 THEN skewness({x}) END, 6) AS skewness, "
                        f"CASE WHEN count({x}) < 3 OR skewness({x}) IS NULL THEN NULL "
                        f"WHEN abs(skewness({x})) < 0.5 THEN 'normal' "
                        f"WHEN abs(skewness({x})) < 1.0 THEN 'moderately skewed' "
                        f"ELSE 'highly skewed' END AS skew_class")
        else:
            num = ("NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, "
                   "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS q25, NULL::DOUBLE AS q75")
            if skew:
                num += ", NULL::DOUBLE AS skewness, NULL::VARCHAR AS skew_class"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{dt}' AS dtype, '{kind}' AS kind, {i} AS ordinal, "
            f"{nd} AS n_distinct, count(*) - count({c}) AS n_null, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, "
            f"{card} AS cardinality, {num} FROM {t}")
    return " UNION ALL ".join(parts)


EVENTS_N_PROFILE = [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"),
                    ("user_id", "bigint", "numeric"), ("event_type", "string", "categorical"),
                    ("value", "double", "numeric")]


@register("profile_columns", _profile_sql(EVENTS_N_SQL, EVENTS_N_PROFILE))
def q_profile(spark, d):
    return rounded(A.column_profile(events_n(spark, d)))


LINEITEM_PROFILE = [("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"), ("l_suppkey", "bigint", "numeric"),
                    ("l_linenumber", "int", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
                    ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"), ("l_returnflag", "string", "categorical"),
                    ("l_linestatus", "string", "categorical"), ("l_shipdate", "timestamp_ntz", "datetime")]


@register("stats_skewness", _profile_sql(
    "lineitem", LINEITEM_PROFILE, bounds=(10, 50), skew=True).replace(
    "count(DISTINCT l_discount)", "count(DISTINCT l_discount + 0.0)").replace("count(DISTINCT l_tax)", "count(DISTINCT l_tax + 0.0)"))
def q_stats_skewness(spark, d):
    return rounded(A.chart_stats(table(spark, d, "lineitem")))


def _top_sql(t: str, cols: list[str], k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {t} "
                               f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)
    return f"""SELECT * FROM (SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank,
        value, count FROM ({parts})) WHERE rank <= {k}"""


@register("profile_top_categories", _top_sql("part", ["p_name", "p_brand", "p_type"], 10))
def q_profile_top(spark, d):
    prof = A.column_profile(table(spark, d, "part"), top_k=10)
    return prof.select("column", F.posexplode("top").alias("pos", "one")).select(
        "column", (F.col("pos") + 1).cast("int").alias("rank"), "one.value", "one.count")


@register("top_categories_sketch", _top_sql("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"], 5))
def q_top_categories_sketch(spark, d):
    """Candidates of heavy-hitter sketches, recounted; the flat o_custkey is counted in full."""
    return A.top_categories(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 5, approx=True)


def _strong_sql(t: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return f"""SELECT col_x, col_y, round(r, 6) AS r FROM (""" + " UNION ALL ".join(
        f"SELECT {i} AS o, '{a}' AS col_x, '{b}' AS col_y, CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN corr({a}, {b}) END AS r FROM {t}"
        for i, (a, b) in enumerate(pairs)) + ") WHERE abs(r) > 0.5 ORDER BY o LIMIT 10"


_REVENUE_SQL = "(SELECT *, l_extendedprice * (1 - l_discount) AS revenue, -l_quantity AS taken FROM lineitem)"


@register("stats_strong_pairs", _strong_sql(_REVENUE_SQL, [c for c, _, k in LINEITEM_PROFILE if k == "numeric"] + ["revenue", "taken"]))
def q_stats_strong_pairs(spark, d):
    li = table(spark, d, "lineitem").selectExpr("*", "l_extendedprice * (1 - l_discount) AS revenue", "-l_quantity AS taken")
    stats = A.chart_stats(li, top_k=5)
    return rounded(stats.select(F.col("column").alias("col_x"), F.inline("strong").alias("col_y", "r")))


@register("top_values", """
SELECT "column", value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank
  FROM (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS count FROM part GROUP BY p_brand
        UNION ALL
        SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size
        UNION ALL
        SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type))
WHERE rank <= 10""")
def q_top_values(spark, d):
    return A.top_values(table(spark, d, "part"), ["p_brand", "p_size", "p_type"], 10)


@register("scalar_aggs", """
SELECT count(*) AS row_count, round(avg(l_extendedprice), 6) AS mean,
       round(sum(l_extendedprice), 2) AS sum, max(l_extendedprice) AS max, min(l_extendedprice) AS min,
       count(l_extendedprice) AS non_null_count FROM lineitem""")
def q_scalar_aggs(spark, d):
    r = A.scalar_aggs(table(spark, d, "lineitem"), "l_extendedprice")
    return r.select("row_count", F.round("mean", 6).alias("mean"), F.round("sum", 2).alias("sum"),
                    "max", "min", "non_null_count")


@register("scalar_aggs_extra", """
SELECT count(*) AS row_count, round(median(o_totalprice), 6) AS median,
       round(stddev_samp(o_totalprice), 6) AS std, count(o_totalprice) AS non_null_count FROM orders""")
def q_scalar_aggs_extra(spark, d):
    return rounded(A.scalar_aggs(table(spark, d, "orders"), "o_totalprice", ("median", "std", "count")))


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(t: str, cols: list[str], diagonal: bool = True) -> str:
    parts = []
    for i, a in enumerate(cols):
        if diagonal:
            parts.append(f"SELECT '{a}' AS col_x, '{a}' AS col_y, "
                         f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END AS r FROM {t}")
        for b in cols[i + 1:]:
            r = f"round(CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN corr({a}, {b}) END, 6)"
            parts.append(f"SELECT '{a}', '{b}', {r} FROM {t}")
            parts.append(f"SELECT '{b}', '{a}', {r} FROM {t}")
    return " UNION ALL ".join(parts)


@register("corr_matrix", _corr_sql("lineitem", CORR_COLS))
def q_corr_matrix(spark, d):
    return rounded(A.corr_matrix(table(spark, d, "lineitem"), CORR_COLS))


@register("corr_pair", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def q_corr_pair(spark, d):
    return rounded(A.corr_pair(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@register("corr_with_target", """
SELECT 'p_partkey' AS "column", round(corr(p_partkey, p_retailprice), 6) AS r FROM part
UNION ALL SELECT 'p_size', round(corr(p_size, p_retailprice), 6) FROM part""")
def q_corr_with_target(spark, d):
    return rounded(A.corr_with_target(table(spark, d, "part"), "p_retailprice"))


@register("category_relation", """
SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, count(l_extendedprice) AS count
FROM lineitem GROUP BY l_returnflag""")
def q_category_relation(spark, d):
    return rounded(A.category_relation(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@register("value_counts_topk", """
SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 5""")
def q_value_counts(spark, d):
    return A.value_counts(table(spark, d, "part"), "p_brand", 5)


@register("group_size", """
SELECT o_orderstatus, o_orderpriority, count(*) AS size FROM orders
GROUP BY o_orderstatus, o_orderpriority""")
def q_group_size(spark, d):
    return A.group_size(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("nunique", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM orders"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def q_nunique(spark, d):
    return A.nunique(table(spark, d, "orders"))


@register("distinct_values", "SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL")
def q_distinct_values(spark, d):
    return A.distinct_values(table(spark, d, "part"), "p_type")


@register("mode_value", """
SELECT (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
        ORDER BY count(*) DESC, p_brand LIMIT 1) AS p_brand,
       (SELECT p_size FROM part WHERE p_size IS NOT NULL GROUP BY p_size
        ORDER BY count(*) DESC, p_size LIMIT 1) AS p_size""")
def q_mode_value(spark, d):
    return A.mode_value(table(spark, d, "part"), ["p_brand", "p_size"])


@register("best_group", """
SELECT l_shipmode_flag AS l_returnflag, v AS l_extendedprice FROM (
  SELECT l_returnflag AS l_shipmode_flag, round(avg(l_extendedprice), 6) AS v FROM lineitem
  WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY avg(l_extendedprice) DESC, l_returnflag
  LIMIT 1)""")
def q_best_group(spark, d):
    return rounded(A.best_group(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@register("worst_group", """
SELECT o_orderpriority, round(avg(o_totalprice), 6) AS o_totalprice FROM orders
GROUP BY o_orderpriority ORDER BY avg(o_totalprice), o_orderpriority LIMIT 1""")
def q_worst_group(spark, d):
    return rounded(A.best_group(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", worst=True))


@register("having_filter", """
SELECT l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem
GROUP BY l_suppkey HAVING sum(l_quantity) > 15500""")
def q_having(spark, d):
    return A.having_filter(table(spark, d, "lineitem"), "l_suppkey", {"l_quantity": "sum"},
                           "l_quantity > 15500")


QS = [0.1, 0.25, 0.5, 0.75, 0.9]


@register("quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 6) AS value FROM lineitem"
    for c in ("l_quantity", "l_extendedprice") for q in QS))
def q_quantiles(spark, d):
    return rounded(A.quantiles(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], QS))


@register("quantiles_grouped", " UNION ALL ".join(
    f"SELECT o_orderstatus, 'o_totalprice' AS \"column\", CAST({q} AS DOUBLE) AS q, "
    f"round(quantile_cont(o_totalprice, {q}), 6) AS value FROM orders GROUP BY o_orderstatus"
    for q in (0.25, 0.5, 0.75)))
def q_quantiles_grouped(spark, d):
    return rounded(A.quantiles(table(spark, d, "orders"), ["o_totalprice"], (0.25, 0.5, 0.75),
                               by="o_orderstatus"))


@register("percent_breakdown", """
SELECT o_orderpriority, count(*) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM orders WHERE o_orderpriority IS NOT NULL), 4) AS percent
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_percent(spark, d):
    return A.percent_breakdown(table(spark, d, "orders"), "o_orderpriority")


@register("column_range", "SELECT min(p_retailprice) AS min, max(p_retailprice) AS max FROM part")
def q_column_range(spark, d):
    return A.column_range(table(spark, d, "part"), "p_retailprice")


@register("schema_listing", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, '{fam}' AS family, "
    f"count({c}) AS non_null FROM orders"
    for i, (c, t, fam) in enumerate([
        ("o_orderkey", "bigint", "number"), ("o_custkey", "bigint", "number"),
        ("o_orderstatus", "string", "object"), ("o_totalprice", "double", "number"),
        ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "object")])))
def q_schema_listing(spark, d):
    return A.schema_counts(table(spark, d, "orders"))


# =====================================================================
# SET / RSH
# =====================================================================

@register("union_tables", """
SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL
SELECT * FROM orders WHERE o_orderstatus = 'O' UNION ALL
SELECT * FROM orders WHERE o_orderstatus = 'P'""")
def q_union(spark, d):
    o = table(spark, d, "orders")
    parts = [S.filter_rows(o, f"o_orderstatus = '{s}'") for s in "FOP"]
    return J.concat_tables(parts)


@register("union_keys", """
SELECT *, 'early' AS source FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL
SELECT *, 'late' AS source FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def q_union_keys(spark, d):
    o = table(spark, d, "orders")
    early = S.filter_rows(o, "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    late = S.filter_rows(o, "o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return J.concat_tables([early, late], keys=["early", "late"])


@register("pivot_mean", """
SELECT l_returnflag,
       round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS "F",
       round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS "O"
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY l_returnflag""")
def q_pivot_mean(spark, d):
    return rounded(X.pivot_table(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus",
                                 values="l_quantity", aggfunc="mean"))


@register("pivot_multi", """
SELECT o_orderpriority,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS o_totalprice_F,
       round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o_totalprice_O,
       round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS o_totalprice_P,
       count(CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS o_custkey_F,
       count(CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS o_custkey_O,
       count(CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS o_custkey_P
FROM orders GROUP BY o_orderpriority""")
def q_pivot_multi(spark, d):
    o = table(spark, d, "orders")
    s = X.pivot_table(o, "o_orderpriority", "o_orderstatus", values=["o_totalprice"], aggfunc="sum")
    c = X.pivot_table(o, "o_orderpriority", "o_orderstatus", values=["o_custkey"], aggfunc="count")
    return rounded(J.merge_tables(s, c, on="o_orderpriority"), 2)


@register("unpivot", """
SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def q_unpivot(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return X.melt_unpivot(p, "p_partkey")


@register("unpivot_text", """
SELECT c_custkey, 'c_name' AS variable, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer""")
def q_unpivot_text(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return X.melt_unpivot(c, ["c_custkey"])


@register("pivot_two_columns", """
SELECT o_orderpriority, """ + ", ".join(
    f"round(sum(CASE WHEN o_orderstatus = '{st}' AND year(o_orderdate) = {y} THEN o_totalprice ELSE 0 END), 2) AS \"{st}_{y}\""
    for st in "FOP" for y in range(1995, 2002)) + """
FROM orders GROUP BY o_orderpriority""")
def q_pivot_two(spark, d):
    """Two pivot columns; a pair that never occurs has no column of its own."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    out = X.pivot_table(o, "o_orderpriority", ["o_orderstatus", "y"], values="o_totalprice", aggfunc="sum")
    every = [f"{st}_{y}" for st in "FOP" for y in range(1995, 2002)]
    return rounded(out.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in out.columns else F.lit(0.0).alias(c) for c in every]), 2)


@register("pivot_cells", """
SELECT l_returnflag, CAST(l_partkey AS VARCHAR) AS l_partkey, round(sum(l_quantity), 2) AS l_quantity
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_partkey IS NOT NULL GROUP BY ALL""")
def q_pivot_cells(spark, d):
    """The sparse pivot: any number of pivoted values as (index, value, cell) rows."""
    out = X.pivot_cells(table(spark, d, "lineitem"), "l_returnflag", "l_partkey", "l_quantity", "sum")
    return rounded(out, 2)


@register("one_hot_sparse", """
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS code FROM orders WHERE o_custkey IS NOT NULL""")
def q_one_hot_sparse(spark, d):
    """Codes of a column with any number of values, through a value dictionary."""
    codes, cells = X.one_hot_sparse(table(spark, d, "orders"), "o_custkey", key="o_orderkey")
    return cells.select("o_orderkey", F.col("code"))


@register("one_hot", """
SELECT o_orderkey, o_totalprice,
       coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F,
       coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O,
       coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P FROM orders""")
def q_one_hot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return X.one_hot_encode(o, "o_orderstatus")


@register("one_hot_drop_first", f"""
SELECT event_id,
       coalesce(event_type = 'error', false) AS event_type_error,
       coalesce(event_type = 'purchase', false) AS event_type_purchase,
       coalesce(event_type = 'signup', false) AS event_type_signup,
       coalesce(event_type = 'view', false) AS event_type_view FROM {EVENTS_N_SQL}""")
def q_one_hot_drop_first(spark, d):
    e = events_n(spark, d).select("event_id", "event_type")
    return X.one_hot_encode(e, "event_type", drop_first=True)


# =====================================================================
# WIN: fills, de-duplication, best row, growth, rolling, cohorts, funnel
# =====================================================================

EVN = EVENTS_N_SQL
FWD = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BWD = "OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("ffill", f"""
SELECT event_id, ts, user_id,
       coalesce(event_type, last_value(event_type IGNORE NULLS) {FWD}) AS event_type,
       coalesce(value, last_value(value IGNORE NULLS) {FWD}) AS value
FROM {EVN}""")
def q_ffill(spark, d):
    return K.fill_missing(events_n(spark, d), method="ffill", columns=["event_type", "value"],
                          order_by="event_id")


@register("bfill", f"""
SELECT event_id, ts, user_id,
       coalesce(event_type, first_value(event_type IGNORE NULLS) {BWD}) AS event_type,
       coalesce(value, first_value(value IGNORE NULLS) {BWD}) AS value
FROM {EVN}""")
def q_bfill(spark, d):
    return K.fill_missing(events_n(spark, d), method="bfill", columns=["event_type", "value"],
                          order_by="event_id")


@register("interpolate_linear", f"""
WITH b AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM {EVN}),
c AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS)
    OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
  last_value(value IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS)
    OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,
  first_value(value IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM b)
SELECT event_id, ts, user_id, event_type,
       round(coalesce(value, CASE WHEN pp IS NULL THEN NULL WHEN np IS NULL THEN pv
                                  ELSE pv + (nv - pv) * ((p - pp) / (np - pp)) END), 6) AS value
FROM c""")
def q_interpolate(spark, d):
    out = K.fill_missing(events_n(spark, d), methods={"value": "interpolate"},
                         interpolate_method="linear", order_by="event_id")
    return rounded(out)


DEDUP_IN = "(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)"


@register("dedup_first", f"""
SELECT o_orderkey, o_custkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn
  FROM {DEDUP_IN}) WHERE rn = 1""")
def q_dedup_first(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return K.drop_rows(o, subset=["o_custkey", "o_orderstatus"], keep="first", order_by="o_orderkey")


@register("dedup_last", f"""
SELECT o_orderkey, o_custkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn
  FROM {DEDUP_IN}) WHERE rn = 1""")
def q_dedup_last(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return K.drop_rows(o, subset=["o_custkey", "o_orderstatus"], keep="last", order_by="o_orderkey")


@register("dedup_none", f"""
SELECT o_orderkey, o_custkey, o_orderstatus FROM (
  SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM {DEDUP_IN}) WHERE n = 1""")
def q_dedup_none(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return K.drop_rows(o, subset=["o_custkey", "o_orderstatus"], keep=False)


@register("dedup_nulls", f"""
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM {EVN})
WHERE rn = 1""")
def q_dedup_nulls(spark, d):
    return K.drop_rows(events_n(spark, d), subset=["user_id", "event_type"], keep="first",
                       order_by="event_id")


@register("dedup_stats", """
SELECT count(*) AS original_rows, count(DISTINCT (o_custkey, o_orderstatus)) AS unique_keys,
       count(DISTINCT (o_custkey, o_orderstatus)) AS kept_rows,
       count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS dropped_rows FROM orders""")
def q_dedup_stats(spark, d):
    return K.duplicate_stats(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@register("best_row_per_group", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL) WHERE rn = 1""")
def q_best_row(spark, d):
    return W.best_row_per_group(table(spark, d, "orders"), "o_custkey", "o_totalprice",
                                tie_break="o_orderkey")


@register("worst_row_per_group", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber,
                                                                l_partkey) AS rn
  FROM lineitem) WHERE rn = 1""")
def q_worst_row(spark, d):
    return W.best_row_per_group(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", largest=False,
                                tie_break=["l_orderkey", "l_linenumber", "l_partkey"])


GROWTH_SQL = """
WITH g AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS o_year,
                  sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_year, round(s, 2) AS o_totalprice,
       round(CASE WHEN row_number() OVER w = 1 THEN 0.0
                  ELSE (s - lag(s) OVER w) * 100.0 / nullif(lag(s) OVER w, 0) END, 6) AS growth_pct
FROM g WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_year)"""


@register("growth_pct", GROWTH_SQL)
def q_growth(spark, d):
    o = table(spark, d, "orders").withColumn("o_year", F.year("o_orderdate"))
    g = W.growth_pct(o, "o_year", "o_totalprice", by="o_orderpriority")
    return g.select("o_orderpriority", "o_year", F.round("o_totalprice", 2).alias("o_totalprice"),
                    F.round("growth_pct", 6).alias("growth_pct"))


@register("rolling_avg", """
SELECT event_id, ts, user_id, event_type, value, props,
       round(CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END, 6) AS value_rolling_mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def q_rolling(spark, d):
    out = W.rolling(table(spark, d, "events"), "value", 5, order_by=["ts", "event_id"],
                    partition_by="user_id", fn="mean")
    return rounded(out)


@register("rolling_global", """
SELECT o_orderkey, o_totalprice,
       round(CASE WHEN count(o_totalprice) OVER w >= 7 THEN sum(o_totalprice) OVER w END, 2) AS o_totalprice_rolling_sum
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_rolling_global(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    out = W.rolling(o, "o_totalprice", 7, order_by=["o_orderdate", "o_orderkey"], fn="sum")
    return rounded(out.drop("o_orderdate"), 2)


@register("running_total_nulls", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 AND event_id > 4 THEN value END AS v FROM events)
SELECT event_id, v, round(sum(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running_total FROM e""")
def q_running_total_nulls(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(
        (F.col("event_id") % 3 > 0) & (F.col("event_id") > 4), F.col("value")).alias("v"))
    return W.running_total(e, "v", ["event_id"]).select("event_id", "v", F.round("running_total", 4).alias("running_total"))


@register("running_total", """
SELECT event_id, user_id, value,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_total
FROM events""")
def q_running_total(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", "ts")
    out = W.running_total(e, "value", order_by=["ts", "event_id"], partition_by="user_id")
    return rounded(out.drop("ts"), 4)


@register("running_total_global", """
SELECT o_orderkey, o_totalprice,
       round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
FROM orders""")
def q_running_total_global(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    out = W.running_total(o, "o_totalprice", order_by=["o_orderdate", "o_orderkey"])
    return rounded(out.drop("o_orderdate"), 2)


@register("decile", """
SELECT *, CAST(ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS ntile FROM orders""")
def q_decile(spark, d):
    return W.ntile(table(spark, d, "orders"), "o_totalprice", 10, tie_break="o_orderkey")


@register("decile_grouped", """
SELECT *, CAST(ntile(4) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber,
                                                            l_partkey, l_suppkey) AS INTEGER) AS ntile
FROM lineitem""")
def q_decile_grouped(spark, d):
    return W.ntile(table(spark, d, "lineitem"), "l_extendedprice", 4,
                   tie_break=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                   partition_by="l_returnflag")


@register("percent_rank", """
SELECT *, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS percent_rank
FROM orders""")
def q_percent_rank(spark, d):
    out = W.percent_rank(table(spark, d, "orders"), "o_totalprice", partition_by="o_orderstatus")
    return out.withColumn("percent_rank", F.round("percent_rank", 9))


@register("percent_rank_ties", """
SELECT l_orderkey, l_linenumber, l_quantity,
       round(percent_rank() OVER (ORDER BY l_quantity), 9) AS percent_rank FROM lineitem""")
def q_percent_rank_ties(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return W.percent_rank(li, "l_quantity").withColumn("percent_rank", F.round("percent_rank", 9))


@register("yoy_growth", """
WITH g AS (SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS s
           FROM orders GROUP BY 1)
SELECT period, round(s, 2) AS o_totalprice,
       round(CASE WHEN row_number() OVER w = 1 THEN 0.0
                  ELSE (s - lag(s) OVER w) * 100.0 / nullif(lag(s) OVER w, 0) END, 6) AS growth_pct
FROM g WINDOW w AS (ORDER BY period)""")
def q_yoy(spark, d):
    g = W.period_growth(table(spark, d, "orders"), "o_orderdate", "o_totalprice", unit="year")
    return g.select("period", F.round("o_totalprice", 2).alias("o_totalprice"),
                    F.round("growth_pct", 6).alias("growth_pct"))


@register("mom_growth", """
WITH g AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period,
                  count(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, period, s AS o_totalprice,
       round(CASE WHEN row_number() OVER w = 1 THEN 0.0
                  ELSE (s - lag(s) OVER w) * 100.0 / nullif(lag(s) OVER w, 0) END, 6) AS growth_pct
FROM g WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period)""")
def q_mom(spark, d):
    g = W.period_growth(table(spark, d, "orders"), "o_orderdate", "o_totalprice", unit="month",
                        by="o_orderstatus", agg="count")
    return rounded(g)


@register("cohort_retention", """
WITH p AS (SELECT DISTINCT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS period FROM events
           WHERE user_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT user_id, min(period) AS cohort FROM p GROUP BY user_id),
j AS (SELECT cohort, CAST(datediff('day', cohort, period) AS INTEGER) AS period_offset, count(*) AS users
      FROM p JOIN c USING (user_id) GROUP BY 1, 2),
s AS (SELECT cohort, users AS cohort_size FROM j WHERE period_offset = 0)
SELECT j.cohort, period_offset, users, cohort_size, round(users * 100.0 / cohort_size, 4) AS retention_pct
FROM j JOIN s USING (cohort)""")
def q_cohort(spark, d):
    return W.cohort_retention(table(spark, d, "events"), "user_id", "ts", unit="day")


@register("funnel", """
WITH s1 AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id),
s2 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s1 ON e.user_id = s1.user_id
       WHERE e.event_type = 'click' AND e.ts >= s1.t GROUP BY e.user_id),
s3 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s2 ON e.user_id = s2.user_id
       WHERE e.event_type = 'purchase' AND e.ts >= s2.t GROUP BY e.user_id)
SELECT 1 AS step_index, 'view' AS step, count(*) AS users FROM s1
UNION ALL SELECT 2, 'click', count(*) FROM s2
UNION ALL SELECT 3, 'purchase', count(*) FROM s3""")
def q_funnel(spark, d):
    return W.funnel(table(spark, d, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"])


_FUNNEL = ["view", "click", "view", "signup", "purchase", "error"]


@register("funnel_six_steps", f"""
WITH RECURSIVE s(i, e) AS (VALUES {', '.join(f"({i}, '{e}')" for i, e in enumerate(_FUNNEL, 1))}),
r AS (SELECT 1 AS i, user_id, min(ts) AS t FROM events WHERE event_type = '{_FUNNEL[0]}' GROUP BY user_id
      UNION ALL
      SELECT DISTINCT r.i + 1, r.user_id, min(v.ts) OVER (PARTITION BY r.user_id)
      FROM r JOIN s ON s.i = r.i + 1 JOIN events v ON v.user_id = r.user_id AND v.event_type = s.e AND v.ts >= r.t)
SELECT s.i AS step_index, s.e AS step, count(r.user_id) AS users FROM s LEFT JOIN r ON r.i = s.i GROUP BY s.i, s.e""")
def q_funnel_six(spark, d):
    """A step that comes twice, and more steps, in the same one scan."""
    return W.funnel(table(spark, d, "events"), "user_id", "ts", "event_type", _FUNNEL)


@register("trend", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(sum(value), 2) AS value
FROM events GROUP BY 1""")
def q_trend(spark, d):
    return rounded(W.trend(table(spark, d, "events"), "ts", "value", unit="day", fn="sum"), 2)


# =====================================================================
# STR / REP  (whole document texts)
# =====================================================================

WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@register("strip", f"""
SELECT doc_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text, lang, source, n_chars
FROM documents""")
def q_strip(spark, d):
    return K.clean_strings(table(spark, d, "documents"), "text", "strip")


@register("lower_upper", """
SELECT doc_id, lower(text) AS text, lang, source, n_chars FROM documents""")
def q_lower(spark, d):
    return K.clean_strings(table(spark, d, "documents"), "text", "lower")


@register("upper_names", "SELECT p_partkey, upper(p_name) AS p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def q_upper(spark, d):
    return K.clean_strings(table(spark, d, "part"), "p_name", "upper")


@register("title_case", r"""
SELECT doc_id,
       list_aggr(list_transform(regexp_extract_all(text, '\pL+|\PL+'),
                                lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || lower(x[2:])),
                 'string_agg', '') AS text,
       lang, source, n_chars
FROM documents""")
def q_title(spark, d):
    return K.clean_strings(table(spark, d, "documents"), "text", "title")


@register("replace_pattern", r"""
SELECT doc_id, regexp_replace(text, '\d+', '#', 'g') AS text, lang, source, n_chars FROM documents""")
def q_replace_pattern(spark, d):
    return K.clean_strings(table(spark, d, "documents"), "text", "replace", pattern=r"\d+", replacement="#")


@register("normalize_ascii", r"""
SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS text, lang, source, n_chars
FROM documents""")
def q_normalize(spark, d):
    return K.clean_strings(table(spark, d, "documents"), "text", "normalize")


@register("clean_chain", rf"""
SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')), '\s+', ' ', 'g') AS text,
       lang, source, n_chars FROM documents""")
def q_clean_chain(spark, d):
    return K.clean_strings(table(spark, d, "documents"), "text", operations=["strip", "lower", "replace"],
                           pattern=r"\s+", replacement=" ")


@register("replace_exact", """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'open'
            ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, o_orderdate,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def q_replace_exact(spark, d):
    return K.replace_values(table(spark, d, "orders"),
                            {"o_orderstatus": {"F": "finished", "O": "open"},
                             "o_orderpriority": {"1-URGENT": "urgent"},
                             "o_totalprice": {"1000": 0.0}})


@register("replace_regex", """
SELECT p_partkey, regexp_replace(regexp_replace(p_name, '^small ', 'tiny ', 'g'), 'gear$', 'cog', 'g') AS p_name,
       p_brand, p_type, p_size, p_retailprice FROM part""")
def q_replace_regex(spark, d):
    return K.replace_values(table(spark, d, "part"), {"p_name": {"^small ": "tiny ", "gear$": "cog"}}, regex=True)


@register("replace_ci", """
SELECT p_partkey, regexp_replace(p_name, 'RED', 'Crimson', 'gi') AS p_name, p_brand, p_type, p_size,
       p_retailprice FROM part""")
def q_replace_ci(spark, d):
    return K.replace_values(table(spark, d, "part"), {"p_name": {"RED": "Crimson"}}, case_insensitive=True)


@register("replace_single_value", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'low' ELSE o_orderpriority END
         AS o_orderpriority
FROM orders""")
def q_replace_single(spark, d):
    return K.replace_values(table(spark, d, "orders"), {"o_orderpriority": ["4-NOT SPECIFIED", "5-LOW"]},
                            value="low")


# =====================================================================
# FIL / OUT
# =====================================================================

@register("fill_constant", f"""
SELECT event_id, ts, user_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, 0.0) AS value
FROM {EVN}""")
def q_fill_constant(spark, d):
    return K.fill_missing(events_n(spark, d), values={"event_type": "unknown", "value": 0.0})


@register("fill_mean", f"""
SELECT event_id, ts, user_id, event_type,
       round(coalesce(value, (SELECT avg(value) FROM {EVN})), 6) AS value FROM {EVN}""")
def q_fill_mean(spark, d):
    return rounded(K.fill_missing(events_n(spark, d), methods={"value": "mean"}))


@register("fill_median", f"""
SELECT event_id, ts, user_id, event_type,
       round(coalesce(value, (SELECT median(value) FROM {EVN})), 6) AS value FROM {EVN}""")
def q_fill_median(spark, d):
    return rounded(K.fill_missing(events_n(spark, d), methods={"value": "median"}))


@register("fill_mode", f"""
SELECT event_id, ts, user_id,
       coalesce(event_type, (SELECT event_type FROM {EVN} WHERE event_type IS NOT NULL
                             GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
       value FROM {EVN}""")
def q_fill_mode(spark, d):
    return K.fill_missing(events_n(spark, d), methods={"event_type": "mode"})


@register("fill_report", f"""
SELECT 'event_type' AS "column", count(*) - count(event_type) AS missing_before, 0 AS missing_after,
       count(*) - count(event_type) AS filled FROM {EVN}
UNION ALL
SELECT 'value', count(*) - count(value), count(*) - count(value), 0 FROM {EVN}""")
def q_fill_report(spark, d):
    before = events_n(spark, d)
    after = K.fill_missing(before, methods={"event_type": "mode"})
    return K.fill_report(before, after, ["event_type", "value"])


IQR_CTE = """b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a1, quantile_cont(l_extendedprice, 0.75) AS a3,
                 quantile_cont(l_quantity, 0.25) AS b1, quantile_cont(l_quantity, 0.75) AS b3 FROM lineitem)"""


@register("outliers_iqr_remove", f"""
WITH {IQR_CTE}
SELECT l.* FROM lineitem l, b
WHERE NOT coalesce(l_extendedprice < a1 - 1.5 * (a3 - a1) OR l_extendedprice > a3 + 1.5 * (a3 - a1)
                   OR l_quantity < b1 - 1.5 * (b3 - b1) OR l_quantity > b3 + 1.5 * (b3 - b1), false)""")
def q_outliers_iqr(spark, d):
    return K.remove_outliers(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], "iqr")


@register("outliers_zscore_remove", f"""
WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {EVN})
SELECT e.* FROM {EVN} e, b
WHERE NOT coalesce(value < m - 2.5 * s OR value > m + 2.5 * s, false)""")
def q_outliers_z(spark, d):
    return K.remove_outliers(events_n(spark, d), ["value"], "zscore", threshold=2.5)


@register("outliers_cap", f"""
WITH {IQR_CTE}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       round(CASE WHEN l_extendedprice < a1 - 1.5 * (a3 - a1) THEN a1 - 1.5 * (a3 - a1)
                  WHEN l_extendedprice > a3 + 1.5 * (a3 - a1) THEN a3 + 1.5 * (a3 - a1)
                  ELSE l_extendedprice END, 6) AS l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem, b""")
def q_outliers_cap(spark, d):
    li = table(spark, d, "lineitem")
    out = K.remove_outliers(li, ["l_extendedprice"], "iqr", handle_method="cap")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@register("outlier_report", f"""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {EVN}),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT 'value' AS "column", round(lo, 6) AS lower, round(hi, 6) AS upper,
       count(*) FILTER (WHERE value < lo OR value > hi) AS outliers,
       count(*) FILTER (WHERE value < lo) AS below, count(*) FILTER (WHERE value > hi) AS above
FROM {EVN}, f GROUP BY lo, hi""")
def q_outlier_report(spark, d):
    return rounded(K.outlier_report(events_n(spark, d), ["value"], "iqr"))


# =====================================================================
# MTH / BIN / DAT
# =====================================================================

@register("apply_functions", """
SELECT *, round_even(p_retailprice, 0) AS price_round, p_size * p_size AS size_sq, p_size * 2 AS size_x2,
       abs(p_retailprice - 950) AS dist, upper(p_name) AS name_upper, CAST(p_partkey AS VARCHAR) AS key_text
FROM part""")
def q_apply(spark, d):
    p = table(spark, d, "part")
    p = X.apply_custom(p, "p_retailprice", "round", "price_round")
    p = X.apply_custom(p, "p_size", "square", "size_sq")
    p = X.apply_custom(p, "p_size", "double", "size_x2")
    p = p.withColumn("dist", p["p_retailprice"] - 950)
    p = X.apply_custom(p, "dist", "abs")
    p = X.apply_custom(p, "p_name", "upper", "name_upper")
    return X.apply_custom(p, "p_partkey", "to_string", "key_text")


@register("interaction", """
SELECT *, round(l_extendedprice * l_discount, 6) AS disc_value FROM lineitem""")
def q_interaction(spark, d):
    out = X.create_interaction(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", "disc_value")
    return out.withColumn("disc_value", F.round("disc_value", 6))


@register("interaction_divide", """
SELECT l_orderkey, l_linenumber, l_discount, l_tax, round(l_discount / nullif(l_tax, 0), 6) AS ratio
FROM lineitem""")
def q_interaction_divide(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(X.create_interaction(li, "l_discount", "l_tax", "ratio", "divide"))


@register("interaction_concat", """
SELECT p_partkey, p_brand, p_size, concat(p_brand, CAST(p_size AS VARCHAR)) AS brand_size FROM part""")
def q_interaction_concat(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return X.create_interaction(p, "p_brand", "p_size", "brand_size", "concat")


SCALE_BASE = "SELECT p_partkey, p_name, p_brand, p_type FROM part"


@register("scale_standard", """
WITH s AS (SELECT avg(p_retailprice) AS m1, stddev_samp(p_retailprice) AS s1,
                  avg(p_size) AS m2, stddev_samp(p_size) AS s2 FROM part)
SELECT p_partkey, p_name, p_brand, p_type, round((p_size - m2) / s2, 6) AS p_size,
       round((p_retailprice - m1) / s1, 6) AS p_retailprice FROM part, s""")
def q_scale_standard(spark, d):
    p = table(spark, d, "part")
    return rounded(X.scale_numeric(p, ["p_retailprice", "p_size"], "standard"))


@register("scale_minmax", """
WITH s AS (SELECT min(p_retailprice) AS a1, max(p_retailprice) AS b1, min(p_size) AS a2, max(p_size) AS b2 FROM part)
SELECT p_partkey, p_name, p_brand, p_type, round((p_size - a2) / (b2 - a2), 6) AS p_size,
       round((p_retailprice - a1) / (b1 - a1), 6) AS p_retailprice FROM part, s""")
def q_scale_minmax(spark, d):
    return rounded(X.scale_numeric(table(spark, d, "part"), ["p_retailprice", "p_size"], "minmax"))


@register("scale_robust", """
WITH s AS (SELECT quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS r
           FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / r, 6) AS l_quantity FROM lineitem, s""")
def q_scale_robust(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(X.scale_numeric(li, ["l_quantity"], "robust"))


@register("human_number", """
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_totalprice IS NULL THEN 'N/A'
            WHEN abs(o_totalprice) >= 1e6 THEN printf('%.2fM', o_totalprice / 1e6)
            WHEN abs(o_totalprice) >= 1e3 THEN printf('%.2fK', o_totalprice / 1e3)
            ELSE format('{:,.2f}', o_totalprice) END AS label
FROM orders""")
def q_human(spark, d):
    from ..functions.numbers import human_number
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.withColumn("label", human_number(F.col("o_totalprice")))


@register("bin_equal_width", """
WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
e AS (SELECT lo - (hi - lo) * 0.001 AS e0, lo + (hi - lo) / 4 * 1 AS e1, lo + (hi - lo) / 4 * 2 AS e2,
             lo + (hi - lo) / 4 * 3 AS e3, hi AS e4 FROM m)
SELECT p_partkey, p_retailprice,
       CASE WHEN p_retailprice > e0 AND p_retailprice <= e1 THEN 1 WHEN p_retailprice <= e2 THEN 2
            WHEN p_retailprice <= e3 THEN 3 WHEN p_retailprice <= e4 THEN 4 END AS p_retailprice_bin
FROM part, e""")
def q_bin_equal(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return X.bin_numeric(p, "p_retailprice", 4).drop("p_retailprice_binned")


@register("bin_quantile", """
WITH q AS (SELECT quantile_cont(p_size, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM part)
SELECT p_partkey, p_size,
       CASE WHEN p_size >= e[1] AND p_size <= e[2] THEN 1 WHEN p_size <= e[3] THEN 2
            WHEN p_size <= e[4] THEN 3 WHEN p_size <= e[5] THEN 4 END AS p_size_bin
FROM part, q""")
def q_bin_quantile(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return X.bin_numeric(p, "p_size", 4, qcut=True).drop("p_size_binned")


@register("bin_labels", """
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
e AS (SELECT lo - (hi - lo) * 0.001 AS e0, lo + (hi - lo) / 3 * 1 AS e1, lo + (hi - lo) / 3 * 2 AS e2,
             hi AS e3 FROM m)
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_totalprice > e0 AND o_totalprice <= e1 THEN 'low' WHEN o_totalprice <= e2 THEN 'mid'
            WHEN o_totalprice <= e3 THEN 'high' END AS price_band,
       CASE WHEN o_totalprice > e0 AND o_totalprice <= e1 THEN 1 WHEN o_totalprice <= e2 THEN 2
            WHEN o_totalprice <= e3 THEN 3 END AS o_totalprice_bin
FROM orders, e""")
def q_bin_labels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return X.bin_numeric(o, "o_totalprice", 3, labels=["low", "mid", "high"], new_column="price_band")


@register("date_features", """
SELECT o_orderkey, o_orderdate, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
       coalesce(isodow(o_orderdate) >= 6, false) AS o_orderdate_is_weekend,
       CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday,
       CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year
FROM orders""")
def q_date_features(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return X.create_date_features(o, "o_orderdate")


DATE_TEXT_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'not a date'
                              ELSE strftime(o_orderdate, '%d/%m/%Y') END AS o_date_text FROM orders)"""


@register("parse_dates", f"""
SELECT o_orderkey, o_date_text,
       CAST(year(try_strptime(o_date_text, '%d/%m/%Y')) AS INTEGER) AS o_date_text_year,
       CAST(month(try_strptime(o_date_text, '%d/%m/%Y')) AS INTEGER) AS o_date_text_month,
       coalesce(isodow(try_strptime(o_date_text, '%d/%m/%Y')) >= 6, false) AS o_date_text_is_weekend
FROM {DATE_TEXT_SQL}""")
def q_parse_dates(spark, d):
    o = table(spark, d, "orders")
    text = o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.lit("not a date"))
                    .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("o_date_text"))
    return X.create_date_features(text, "o_date_text", ["year", "month", "is_weekend"], date_format="%d/%m/%Y")


# =====================================================================
# CHD: chart data
# =====================================================================

@register("chart_bar_agg", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_chart_bar_agg(spark, d):
    return rounded(C.chart_data(table(spark, d, "lineitem"), "bar", "l_returnflag", "l_extendedprice", "sum",
                                color="l_linestatus"), 2)


@register("chart_line", """
SELECT o_orderpriority, round(median(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY o_orderpriority""")
def q_chart_line(spark, d):
    return rounded(C.chart_data(table(spark, d, "orders"), "line", "o_orderpriority", "o_totalprice", "median"))


@register("chart_bar_count", """
SELECT p_type, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type
ORDER BY count DESC, p_type LIMIT 20""")
def q_chart_bar_count(spark, d):
    return C.chart_data(table(spark, d, "part"), "bar", "p_type")


@register("chart_pie", """
SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_chart_pie(spark, d):
    return C.chart_data(table(spark, d, "orders"), "pie", "o_orderpriority")


@register("chart_histogram", """
WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30) + 1, 30) AS INTEGER) AS bin,
             count(*) AS n FROM lineitem, m WHERE l_extendedprice IS NOT NULL GROUP BY 1),
a AS (SELECT CAST(i AS INTEGER) AS bin, lo + (i - 1) * ((hi - lo) / 30) AS bin_start,
             lo + i * ((hi - lo) / 30) AS bin_end FROM range(1, 31) r(i), m)
SELECT a.bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, coalesce(n, 0) AS count
FROM a LEFT JOIN c ON a.bin = c.bin""")
def q_chart_histogram(spark, d):
    return rounded(C.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30))


BOX_SQL = """
WITH q AS (SELECT {k} count(l_quantity) AS count, quantile_cont(l_quantity, 0.25) AS q1,
                  quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3
           FROM lineitem WHERE l_quantity IS NOT NULL {w} {g}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT {fk} f.count, f.q1, f.median, f.q3, f.lower_fence, f.upper_fence,
       min(CASE WHEN l_quantity BETWEEN lower_fence AND upper_fence THEN l_quantity END) AS whisker_low,
       max(CASE WHEN l_quantity BETWEEN lower_fence AND upper_fence THEN l_quantity END) AS whisker_high,
       count(*) FILTER (WHERE NOT (l_quantity BETWEEN lower_fence AND upper_fence)) AS outliers
FROM lineitem l JOIN f ON {on} WHERE l_quantity IS NOT NULL
GROUP BY {fk} f.count, f.q1, f.median, f.q3, f.lower_fence, f.upper_fence"""


@register("chart_box", BOX_SQL.format(k="l_returnflag,", w="AND l_returnflag IS NOT NULL",
                                      g="GROUP BY l_returnflag", fk="f.l_returnflag,",
                                      on="l.l_returnflag = f.l_returnflag"))
def q_chart_box(spark, d):
    return C.box_stats(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


@register("chart_box_all", BOX_SQL.format(k="", w="", g="", fk="", on="true"))
def q_chart_box_all(spark, d):
    return C.box_stats(table(spark, d, "lineitem"), "l_quantity")


@register("chart_scatter", "SELECT p_size, p_retailprice, p_type FROM part")
def q_chart_scatter(spark, d):
    return C.scatter_data(table(spark, d, "part"), "p_size", "p_retailprice", color="p_type")


@register("chart_scatter_sample", """
SELECT o_totalprice, o_custkey FROM orders
ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '0')), o_orderkey LIMIT 500""")
def q_chart_scatter_sample(spark, d):
    return C.scatter_data(table(spark, d, "orders"), "o_totalprice", "o_custkey", sample=500, key="o_orderkey")


@register("chart_heatmap_corr", _corr_sql("lineitem", CORR_COLS))
def q_chart_heatmap_corr(spark, d):
    return rounded(C.heatmap_data(table(spark, d, "lineitem"), columns=CORR_COLS))


@register("chart_heatmap_pivot", """
SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 6) AS o_totalprice FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2""")
def q_chart_heatmap_pivot(spark, d):
    return rounded(C.heatmap_data(table(spark, d, "orders"),
                                  columns=["o_orderstatus", "o_orderpriority", "o_totalprice"]))


@register("chart_heatmap_xy", """
SELECT p_type, round(avg(p_size), 6) AS p_size FROM part WHERE p_type IS NOT NULL GROUP BY p_type""")
def q_chart_heatmap_xy(spark, d):
    return rounded(C.heatmap_data(table(spark, d, "part"), x="p_type", y="p_size"))


@register("chart_heatmap_count", """
SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1""")
def q_chart_heatmap_count(spark, d):
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return C.heatmap_data(c, x="c_mktsegment", y="c_nationkey")


@register("chart_combo", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity,
       round(sum(l_extendedprice), 2) AS l_extendedprice
FROM lineitem GROUP BY 1, 2""")
def q_chart_combo(spark, d):
    return rounded(C.combo_data(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice",
                                color="l_linestatus", agg_func="sum"), 2)


@register("chart_fallback_top10", """
SELECT p_brand, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY p_brand
ORDER BY p_brand LIMIT 10""")
def q_chart_fallback(spark, d):
    return rounded(C.fallback_groups(table(spark, d, "part"), "p_brand", "p_retailprice", "mean"))


@register("chart_dashboard", """
SELECT 'by_segment' AS chart, c_mktsegment AS label, count(*) AS count FROM customer GROUP BY c_mktsegment
UNION ALL
SELECT 'by_nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY c_nationkey""")
def q_chart_dashboard(spark, d):
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    charts = C.dashboard(c, [{"name": "by_segment", "chart_type": "pie", "x": "c_mktsegment"},
                             {"name": "by_nation", "chart_type": "pie", "x": "c_nationkey"}])
    parts = [df.select(F.lit(name).alias("chart"), F.col(df.columns[0]).alias("label"), "count")
             for name, df in charts.items()]
    return parts[0].unionByName(parts[1])


# =====================================================================
# CHK: chart checks
# =====================================================================

PART_KINDS = [("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"),
              ("p_type", "categorical"), ("p_size", "numeric"), ("p_retailprice", "numeric")]


def _suitability_sql() -> str:
    prof = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(DISTINCT {c}) AS nd FROM part" for c, k in PART_KINDS)
    return f"""
WITH p AS ({prof}),
q AS (SELECT *, CASE WHEN nd < 10 THEN 'low' WHEN nd < 100 THEN 'medium' ELSE 'high' END AS card FROM p),
c AS (SELECT unnest(['bar', 'pie', 'line', 'histogram', 'scatter', 'box']) AS chart),
r AS (SELECT "column", chart,
        CASE WHEN chart = 'bar' AND kind <> 'categorical' THEN 'bar needs a categorical column'
             WHEN chart = 'bar' AND card = 'high' AND nd > 25 THEN 'too many categories for a bar chart'
             WHEN chart = 'pie' AND kind <> 'categorical' THEN 'pie needs a categorical column'
             WHEN chart = 'pie' AND nd > 10 THEN 'too many categories for a pie chart'
             WHEN chart = 'line' AND kind = 'categorical' AND card = 'high'
               THEN 'high-cardinality text on a line chart'
             WHEN chart IN ('histogram', 'scatter', 'box') AND kind <> 'numeric' THEN 'needs a numeric column'
        END AS reason FROM q, c)
SELECT "column", chart, reason IS NULL AS suitable, reason FROM r"""


@register("chart_suitability", _suitability_sql())
def q_chart_suitability(spark, d):
    return C.suitability(A.column_profile(table(spark, d, "part")))


@register("chart_compatibility", """
SELECT 'bar' AS chart, nd <= 25 AS ok,
       CASE WHEN nd > 25 THEN 'p_brand has ' || nd || ' categories (at most 25)' END AS reason
FROM (SELECT count(DISTINCT p_brand) AS nd FROM part)""")
def q_chart_compat(spark, d):
    return C.compatibility(table(spark, d, "part"), "bar", x="p_brand")


@register("chart_compatibility_reject", """
SELECT 'pie' AS chart, nd <= 10 AS ok,
       CASE WHEN nd > 10 THEN 'o_custkey has ' || nd || ' categories (at most 10)' END AS reason
FROM (SELECT count(DISTINCT o_custkey) AS nd FROM orders)""")
def q_chart_compat_reject(spark, d):
    return C.compatibility(table(spark, d, "orders"), "pie", x="o_custkey")


def _recommendation_sql() -> str:
    num = [c for c, _, k in LINEITEM_PROFILE if k == "numeric"]
    return f"""
WITH p AS ({_strong_sql("lineitem", num)}),
s AS (SELECT count(DISTINCT l_returnflag) AS f, count(DISTINCT l_linestatus) AS l FROM lineitem),
first AS (SELECT col_x, col_y, r, row_number() OVER () AS n FROM p),
b AS (SELECT CASE WHEN f < 50 THEN 'l_returnflag' WHEN l < 50 THEN 'l_linestatus' ELSE 'l_returnflag' END AS c FROM s),
recs AS (
  SELECT 1 AS o, 'line' AS chart, 'l_shipdate' AS x, '{num[0]}' AS y, 'trend of {num[0]} over l_shipdate' AS reason
  UNION ALL SELECT 2, 'scatter', col_x, col_y, 'correlation r=' || printf('%.2f', r) FROM first WHERE n = 1
  UNION ALL SELECT 3, 'bar', c, '{num[0]}', '{num[0]} by ' || c FROM b
  UNION ALL SELECT 4, 'histogram', '{num[0]}', NULL, 'distribution of {num[0]}'
  UNION ALL SELECT 5, 'pie', CASE WHEN f < 10 THEN 'l_returnflag' ELSE 'l_linestatus' END, NULL,
         'share of ' || CASE WHEN f < 10 THEN 'l_returnflag' ELSE 'l_linestatus' END FROM s WHERE f < 10 OR l < 10)
SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS rank, chart, x, y, reason FROM recs"""


@register("chart_recommendation", _recommendation_sql())
def q_chart_recommendation(spark, d):
    return C.recommend_charts(table(spark, d, "lineitem"))


@register("chart_checks", """
SELECT 'area' AS chart, true AS ok, NULL AS reason UNION ALL SELECT 'area', false, 'area needs a numeric y column'
UNION ALL SELECT 'heatmap', false, 'heatmap needs at least two columns'
UNION ALL SELECT 'heatmap', false, 'heatmap columns not in the table: nope' UNION ALL SELECT 'heatmap', true, NULL
UNION ALL SELECT 'line', false, 'o_orderstatus must be numeric or a date' UNION ALL SELECT 'line', true, NULL
UNION ALL SELECT 'scatter', false, 'o_orderdate must be numeric' UNION ALL SELECT 'box', false, 'box needs a numeric y column'
UNION ALL SELECT 'bar', nd <= 25, CASE WHEN nd > 25 THEN 'o_orderpriority has ' || nd || ' categories (at most 25)' END
FROM (SELECT count(DISTINCT o_orderpriority) AS nd FROM orders)""")
def q_chart_checks(spark, d):
    """CHK-2: every rule once; area takes any x and a numeric y, heatmap two columns that are there."""
    o = table(spark, d, "orders")
    asked = [("area", "o_orderstatus", "o_totalprice", None), ("area", "o_orderkey", "o_orderdate", None), ("heatmap", None, None, ["o_orderkey"]),
             ("heatmap", None, None, ["o_orderkey", "nope"]), ("heatmap", None, None, ["o_orderkey", "o_orderstatus"]),
             ("line", "o_orderdate", "o_orderstatus", None), ("line", "o_orderdate", "o_totalprice", None),
             ("scatter", "o_orderkey", "o_orderdate", None), ("box", None, "o_orderstatus", None), ("bar", "o_orderpriority", None, None)]
    out = None
    for chart, x, y, cols in asked:
        one = C.compatibility(o, chart, x, y, cols)
        out = one if out is None else out.unionByName(one)
    return out


# =====================================================================
# IO / VER / UDF / streaming
# =====================================================================

def io_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tw-io/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the plans made inside."""
    old = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@register("csv_roundtrip", """
SELECT * FROM orders""")
def q_csv_roundtrip(spark, d):
    from ..sources.files import read_table, write_csv
    path = io_path(spark, "orders.csv")
    write_csv(table(spark, d, "orders"), path)
    return read_table(spark, path, fmt="csv", types={"o_orderdate": "timestamp_ntz"})


@register("csv_missing_words", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS o_totalprice,
       o_orderstatus || chr(10) || '"' || o_orderpriority || '", x' AS note FROM orders""")
def q_csv_missing_words(spark, d):
    """Missing-value words in numbers; line breaks, quotes and delimiters in quoted text."""
    from ..sources.files import read_csv, write_csv
    path = io_path(spark, "words.csv")
    words = F.element_at(F.array(*map(F.lit, ["NA", "NaN", "null", "N/A"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    write_csv(table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice").cast("string")).otherwise(words).alias("o_totalprice"),
        F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('", x')).alias("note")), path)
    return read_csv(spark, path)


@register("csv_quoted_newline", """
SELECT doc_id, translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), '') AS text, n_chars FROM documents""")
def q_csv_quoted_newline(spark, d):
    """Whole documents, line breaks and quotes and all, through delimited text cut at many splits."""
    from ..sources.files import read_csv, write_csv
    path = io_path(spark, "documents.csv")
    docs = table(spark, d, "documents")
    lines = F.regexp_replace(F.translate("text", "\0", ""), "\r\n?", "\n")
    write_csv(docs.select("doc_id", lines.alias("text"), "n_chars"), path, quote_all=True)
    with _settings(spark, {"spark.sql.files.maxPartitionBytes": "256k"}):
        out = read_csv(spark, path, infer_types=False)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))


@register("csv_encodings", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'é' ELSE 'ß' END || o_orderpriority || CASE WHEN o_orderstatus = 'O' THEN '' ELSE '€' END AS note
FROM orders""")
def q_csv_encodings(spark, d):
    """A folder of files in UTF-8 and in ISO-8859-1: each is read in the encoding its bytes fit."""
    from ..sources.files import read_csv
    root = io_path(spark, "encodings")
    o = table(spark, d, "orders")
    note = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "é").otherwise("ß"), "o_orderpriority")
    west = o.where("o_orderstatus = 'O'").select("o_orderkey", note.alias("note"))
    rest = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.concat(note, F.lit("€")).alias("note"))
    west.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{root}/west")
    rest.write.option("header", True).csv(f"{root}/rest")
    return read_csv(spark, [f"{root}/west", f"{root}/rest"])


@register("csv_bad_rows", """
SELECT p_partkey, p_name, CASE WHEN p_partkey % 10 = 7 THEN NULL ELSE CAST(p_size AS BIGINT) END AS p_size
FROM part WHERE p_partkey % 10 <> 3""")
def q_csv_bad_rows(spark, d):
    from ..sources.files import read_csv
    p = table(spark, d, "part")
    k, n, z = (F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_size"))
    line = (F.when(F.col("p_partkey") % 10 == 3, F.concat_ws(",", k, n, z, F.lit("extra")))
            .when(F.col("p_partkey") % 10 == 7, F.concat_ws(",", k, n))
            .otherwise(F.concat_ws(",", k, n, z)))
    path = io_path(spark, "part-lines")
    p.select(line.alias("value")).write.mode("overwrite").text(path)
    return read_csv(spark, path, header=["p_partkey", "p_name", "p_size"])


@register("json_records", "SELECT CAST(to_json(c) AS VARCHAR) AS record FROM customer c")
def q_json_records(spark, d):
    from ..sources.files import to_json_records
    return to_json_records(table(spark, d, "customer"))


@register("json_roundtrip", "SELECT * FROM customer")
def q_json_roundtrip(spark, d):
    from ..sources.files import read_table, write_json
    path = io_path(spark, "customer.json")
    c = table(spark, d, "customer")
    write_json(c, path)
    back = read_table(spark, path, fmt="json", schema=c.schema)
    return back


@register("drop_empty", f"SELECT * FROM {EVN}")
def q_drop_empty(spark, d):
    from ..sources.files import drop_empty
    e = events_n(spark, d).withColumn("note", F.lit(None).cast("string"))
    return drop_empty(e)


@register("snapshot_roundtrip", "SELECT * FROM orders")
def q_snapshot(spark, d):
    from .versions import SnapshotStore
    store = SnapshotStore(spark, io_path(spark, "versions"))
    v0 = store.save_version({"orders": table(spark, d, "orders"), "nation": table(spark, d, "nation")},
                            operation="load")
    return store.load_version(v0)["orders"]


@register("multi_step_plan", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity,
       round(avg(l_extendedprice), 6) AS l_extendedprice
FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2""")
def q_multi_step_plan(spark, d):
    from .steps import run_steps
    steps = [
        {"op": "filter_rows", "args": {"condition": "l_shipdate < TIMESTAMP_NTZ '1999-01-01 00:00:00'"}},
        {"op": "group_by_agg", "args": {"by": ["l_returnflag", "l_linestatus"],
                                        "agg": {"l_quantity": "sum", "l_extendedprice": "mean"}},
         "output": "summary"},
        {"op": "sort_data", "input": "summary", "args": {"by": ["l_returnflag", "l_linestatus"]},
         "output": "summary"},
    ]
    env = run_steps({"current": table(spark, d, "lineitem")}, steps)
    return rounded(env["summary"])


@register("positional_plan", f"""
WITH a AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM {EVENTS_N_SQL}),
s AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY p) - 1 AS p FROM a WHERE p >= 40 AND p % 2 = 0),
d AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY p) - 1 AS p FROM s
      WHERE p NOT IN (0, 7, 300) AND p <> (SELECT max(p) FROM s)),
f AS (SELECT event_id, user_id, p, last_value(value IGNORE NULLS) OVER (ORDER BY p) AS value FROM d)
SELECT event_id, user_id, value FROM f WHERE p >= 5""")
def q_positional_plan(spark, d):
    """UDF-3 over LIM-3, FLT-7 and WIN-1: four positional steps on one sorted table."""
    from .steps import run_steps
    order = {"order_by": ["event_id"]}
    env = run_steps({"current": events_n(spark, d).select("event_id", "user_id", "value")}, [
        {"op": "slice_rows", "args": {"start": 40, "step": 2, **order}},
        {"op": "drop_rows", "args": {"indices": [0, 7, 300, -1], **order}},
        {"op": "fill_missing", "args": {"method": "ffill", "columns": ["value"], **order}},
        {"op": "slice_rows", "args": {"start": 5, "end": None, **order}}])
    return env["current"]


@register("stream_rowwise", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type, value
FROM events WHERE value > 100""")
def q_stream(spark, d):
    from ..streaming.rowwise import apply_rowwise, read_stream, run_to_files
    src = table(spark, d, "events")
    stream = read_stream(spark, f"{d.rstrip('/')}/events.parquet", src.schema)
    out = apply_rowwise(stream, [
        {"op": "filter_rows", "args": {"condition": "value > 100"}},
        {"op": "replace_values", "args": {"to_replace": {"event_type": {"click": "tap"}}}},
        {"op": "select_columns", "args": {"columns": ["event_id", "event_type", "value"]}},
    ])
    return run_to_files(out, io_path(spark, "stream-out"), io_path(spark, "stream-ckpt"))


# =====================================================================
# reports, catalogue, many files, lineage
# =====================================================================

@register("replace_change_counts", """
SELECT count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM
                        CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE o_orderstatus END) AS o_orderstatus,
       count(*) FILTER (WHERE o_orderpriority IS DISTINCT FROM
                        CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE o_orderpriority END)
         AS o_orderpriority
FROM orders""")
def q_replace_change_counts(spark, d):
    o = table(spark, d, "orders")
    after = K.replace_values(o, {"o_orderstatus": {"F": "finished"}, "o_orderpriority": {"1-URGENT": "urgent"}})
    return K.change_counts(o, after, ["o_orderstatus", "o_orderpriority"], key="o_orderkey")


CATALOGUE_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
                    "nation", "orders", "pages", "part", "region", "supplier"]


@register("table_catalogue", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in CATALOGUE_TABLES))
def q_table_catalogue(spark, d):
    from ..sources.files import load_tables
    tables = load_tables(spark, d)  # what is there
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("csv_many_files", "SELECT *, 'orders_' || o_orderstatus AS table_name FROM orders")
def q_csv_many_files(spark, d):
    from ..sources.files import read_tables, write_csv
    o = table(spark, d, "orders")
    root = io_path(spark, "many")
    paths = []
    for st in ("F", "O", "P"):
        p = f"{root}/orders_{st}.csv"
        write_csv(o.filter(F.col("o_orderstatus") == st), p)
        paths.append(p)
    tables = read_tables(spark, paths)
    parts = [df.withColumns({"o_orderdate": F.col("o_orderdate").cast("timestamp_ntz"), "table_name": F.lit(n)}) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lineage_store(spark, d):
    import time
    from .versions import SnapshotStore
    o = table(spark, d, "orders")
    store = SnapshotStore(spark, io_path(spark, "lineage"))
    for st in ("F", "O", "P"):
        store.save_version({"orders": o.filter(F.col("o_orderstatus") == st)}, operation=f"keep status {st}")
        time.sleep(0.002)
    return store


@register("lineage_prune", """
SELECT *, 'v1' AS version FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT *, 'v2' FROM orders WHERE o_orderstatus = 'P'""")
def q_lineage_prune(spark, d):
    store = _lineage_store(spark, d)
    store.prune(2)
    parts = [store.load_version(r.version)["orders"].withColumn("version", F.lit(r.version))
             for r in store.versions().orderBy("version").collect()]
    return parts[0].unionByName(parts[1])


@register("lineage_search", "SELECT * FROM orders WHERE o_orderstatus = 'P'")
def q_lineage_search(spark, d):
    store = _lineage_store(spark, d)
    hit = store.search("STATUS P", n=1).first()
    return store.load_version(hit.version)["orders"]


# =====================================================================
# Smaller rules of the inventory, one key each
# =====================================================================

@register("filter_case", "SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'O_TOTALPRICE' AND upper(o_orderpriority) LIKE '1%'")
def q_filter_case(spark, d):
    """FLT-4: letter case of names aside, quoted text untouched, under Spark's strict case rule."""
    with _settings(spark, {"spark.sql.caseSensitive": "true"}):
        return S.filter_rows(table(spark, d, "orders"), "O_TotalPrice > @least AND O_ORDERSTATUS <> 'O_TOTALPRICE' AND upper(`O_orderpriority`) LIKE '1%'",
                             {"least": 200000})


@register("filter_ambiguous", "SELECT o_orderkey, o_custkey AS lower_key, o_totalprice FROM orders WHERE o_custkey > 500 AND o_orderkey % 2 = 0")
def q_filter_ambiguous(spark, d):
    """FLT-4: two columns that differ in case only are told apart by their exact names."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").toDF("KEY", "key", "price")
    out = S.filter_rows(o, "key > 500 AND KEY % 2 = 0")
    return out.toDF("o_orderkey", "lower_key", "o_totalprice")


@register("filter_mask", "SELECT * FROM events WHERE value > 50 AND event_type = 'view'")
def q_filter_mask(spark, d):
    return S.filter_rows(table(spark, d, "events"), "value > 50 AND event_type = 'view'", use_query=False)


@register("filter_search", "SELECT * FROM part WHERE p_size BETWEEN 5 AND 25 AND contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'brand#1')")
def q_filter_search(spark, d):
    return S.filter_combined(table(spark, d, "part"), search="Brand#1", ranges={"p_size": (5, 25)})


@register("groupby_as_index", "SELECT o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus")
def q_groupby_as_index(spark, d):
    return rounded(A.group_by_agg(table(spark, d, "orders"), "o_orderstatus", {"o_totalprice": "mean"}, as_index=True))


@register("capped_rows", "SELECT least(count(*), 100000) AS rows FROM lineitem")
def q_capped_rows(spark, d):
    """LIM-5: the cap of what is handed to a caller."""
    return S.cap_rows(table(spark, d, "lineitem")).agg(F.count(F.lit(1)).alias("rows"))


@register("sample_default", f"SELECT * FROM orders ORDER BY {SAMPLE_KEY}, o_orderkey LIMIT 1")
def q_sample_default(spark, d):
    return S.sample_rows(table(spark, d, "orders"), random_state=42, key="o_orderkey")


@register("union_ignore_index", "SELECT * FROM nation UNION ALL SELECT * FROM nation")
def q_union_ignore_index(spark, d):
    n = table(spark, d, "nation")
    return J.concat_tables([n, n], join="inner", ignore_index=True)


@register("join_full_on", """
SELECT k AS o_custkey, a.total, b.late FROM (SELECT o_custkey AS k, sum(o_orderkey) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL OUTER JOIN (SELECT o_custkey AS k, max(o_orderdate) AS late FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b USING (k)""")
def q_join_full_on(spark, d):
    """JN-4: one key column that holds either side's key."""
    o = table(spark, d, "orders")
    a = S.filter_rows(o, "o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sum("o_orderkey").alias("total"))
    b = S.filter_rows(o, "o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("late"))
    return J.merge_tables(a, b, "outer", on="o_custkey")


@register("version_branch", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
def q_version_branch(spark, d):
    store = _lineage_store(spark, d)
    branch = store.create_branch("v1")
    return store.load_version(branch)["orders"]


@register("version_delete", "SELECT 'v0' AS version UNION ALL SELECT 'v2'")
def q_version_delete(spark, d):
    store = _lineage_store(spark, d)
    store.delete_version("v1")
    return store.versions().select("version")


@register("version_undo", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
def q_version_undo(spark, d):
    return _lineage_store(spark, d).undo()["orders"]


@register("transform_callable", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def q_transform_callable(spark, d):
    from .steps import transform_with
    return transform_with(table(spark, d, "orders"), lambda df: df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice")))


@register("statistics_plan", """
WITH f AS (SELECT event_id, user_id, coalesce(value, (SELECT median(value) FROM events_n)) AS value FROM events_n WHERE user_id > 10),
b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM f)
SELECT event_id, user_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS value FROM f, b
WHERE value BETWEEN a - 1.5 * (z - a) AND z + 1.5 * (z - a)""".replace("WITH f AS", f"WITH events_n AS (SELECT * FROM {EVENTS_N_SQL} WHERE user_id > 10), f AS"))
def q_statistics_plan(spark, d):
    """UDF-3: three steps in a row that need statistics of what is before them."""
    from .steps import run_steps
    env = run_steps({"current": events_n(spark, d).select("event_id", "user_id", "value")}, [
        {"op": "filter_rows", "args": {"condition": "user_id > 10"}}, {"op": "fill_missing", "args": {"method": "median", "columns": ["value"]}},
        {"op": "remove_outliers", "args": {"columns": ["value"], "method": "iqr"}},
        {"op": "scale_numeric", "args": {"columns": ["value"], "method": "standard"}}])
    return rounded(env["current"])
