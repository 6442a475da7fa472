"""Plan shape checks: pushdown, pruning, top-k, partial aggregation, no Python."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import analytics as W
from tablewright.operators import cleaning as K
from tablewright.operators import selection as S
from tablewright.plans import catalog

from conftest import SF001


def plan(df) -> str:
    """The formatted physical plan, as ``df.explain("formatted")`` prints it."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_flagship_pushes_filter_and_prunes(spark):
    df = catalog.q_flagship(spark, SF001)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "partial_sum" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double," \
           "l_returnflag:string,l_shipdate:timestamp_ntz>" in p
    assert "TakeOrderedAndProject" in p or "TakeOrdered" in p
    assert "PythonUDF" not in p and "BatchEvalPython" not in p


def test_topk_uses_take_ordered(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    assert "TakeOrderedAndProject" in plan(S.nlargest(o, 10, "o_totalprice", tie_break="o_orderkey"))


def test_best_row_is_partial_aggregate_not_window(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = plan(W.best_row_per_group(o, "o_custkey", "o_totalprice", tie_break="o_orderkey"))
    assert "Window" not in p
    assert "partial_min_by" in p


def test_dedup_is_partial_aggregate(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = plan(K.drop_rows(o, subset=["o_custkey"], keep="first", order_by="o_orderkey"))
    assert "partial_min_by" in p and "Window" not in p


def test_top_values_has_partial_group_limit(spark):
    part = spark.read.parquet(f"{SF001}/part.parquet")
    p = plan(A.top_values(part, ["p_brand", "p_type"], 5))
    assert "WindowGroupLimit" in p and "Partial" in p
    # one column is one group: Spark's top-k keeps five rows a task
    assert "TakeOrderedAndProject" in plan(A.top_values(part, ["p_brand"], 5))


def test_no_python_in_row_operators(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    p = plan(K.clean_strings(d, "text", operations=["strip", "lower", "title"]))
    assert "Python" not in p
    # NFKD is the one Arrow-batched pandas UDF
    assert "ArrowEvalPython" in plan(K.clean_strings(d, "text", "normalize"))


def test_position_has_no_single_partition_exchange(spark):
    from tablewright.order import with_position
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    p = plan(with_position(o, ["o_totalprice", "o_orderkey"]))
    assert "SinglePartition" not in p


def test_profile_single_scan_per_stage(spark):
    e = catalog.events_n(spark, SF001)
    p = plan(A.column_profile(e))
    assert "PythonUDF" not in p


def test_outlier_filter_is_pushed_to_scan(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    p = plan(K.remove_outliers(li, ["l_quantity"], "iqr"))
    assert "PushedFilters" in p and "l_quantity" in p


def test_row_operators_accept_streams(spark):
    e = spark.read.parquet(f"{SF001}/events.parquet")
    from tablewright.streaming.rowwise import read_stream
    stream = read_stream(spark, f"{SF001}/events.parquet", e.schema)
    out = K.replace_values(S.filter_rows(stream, "value > 10"), {"event_type": {"view": "seen"}})
    assert out.isStreaming
    with pytest.raises(Exception):
        A.describe_stats(stream)
    with pytest.raises(Exception):
        K.fill_missing(stream, method="ffill", order_by="event_id")


def test_no_cross_product_in_registered_queries(spark):
    bad = []
    for name in ["revenue_by_nation_flag", "chart_box_all", "percent_breakdown", "outliers_cap"]:
        df = catalog.QUERIES[name](spark, SF001)
        if "CartesianProduct" in plan(df) or "BroadcastNestedLoopJoin" in plan(df):
            bad.append(name)
    assert not bad
    assert F is not None


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    from tablewright.operators import joins as J
    from tablewright.sources.files import write_bucketed
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_extendedprice")
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_custkey")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lb = write_bucketed(li, "tw_li_b", "l_orderkey", 8, str(tmp_path / "li"))
        ob = write_bucketed(o, "tw_o_b", "o_orderkey", 8, str(tmp_path / "o"))
        j = J.merge_tables(lb, ob, left_on="l_orderkey", right_on="o_orderkey", null_equal=False)
        p = plan(j)
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert j.count() == li.join(o, li.l_orderkey == o.o_orderkey).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
