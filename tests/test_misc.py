"""Smaller paths: index joins, inner column concat, index reset, formats."""

import datetime as dt

from pyspark.sql import functions as F

from tablewright.functions.dates import parse_timestamp, strftime_to_spark
from tablewright.functions.numbers import human_number
from tablewright.operators import joins as J
from tablewright.operators import selection as S
from tablewright.sources.files import union_files


def test_merge_on_declared_index(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "p"), (3, "q")], "k int, v string")
    out = J.merge_on_index(a, b, "outer", left_index="k").orderBy("k").collect()
    assert [(r.k, r.v_left, r.v_right) for r in out] == [(1, "x", None), (2, "y", "p"), (3, None, "q")]


def test_concat_columns_inner(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    b = spark.createDataFrame([(9,), (8,)], "b int")
    out = J.concat_tables([a, b], axis=1, join="inner", order_by=["a", "b"]).orderBy("index").collect()
    assert [(r["index"], r.a, r.b) for r in out] == [(0, 1, 8), (1, 2, 9)]


def test_reset_index_positions(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "s string")
    out, names = S.set_index(df, reset=True, order_by="s")
    assert names == ["index"]
    assert [(r["index"], r.s) for r in out.orderBy("index").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_union_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    p1, p2 = str(tmp_path / "a"), str(tmp_path / "b")
    df.write.parquet(p1)
    df.write.parquet(p2)
    assert union_files(spark, [p1, p2]).count() == 2


def test_strftime_translation_and_parse(spark):
    assert strftime_to_spark("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    assert strftime_to_spark("%d/%m/%Y") == "dd/MM/yyyy"
    df = spark.createDataFrame([("2024-03-05T07:08",), ("bad",)], "t string")
    got = [r.p for r in df.select(parse_timestamp(F.col("t"), "%Y-%m-%dT%H:%M").alias("p")).collect()]
    assert got == [dt.datetime(2024, 3, 5, 7, 8), None]


def test_human_number(spark):
    df = spark.createDataFrame([(1234567.0,), (-1500.0,), (12.345,), (None,)], "x double")
    got = [r.h for r in df.select(human_number(F.col("x")).alias("h")).collect()]
    assert got == ["1.23M", "-1.50K", f"{12.345:,.2f}", "N/A"]


def test_cluster_settings_bounds():
    from tablewright.session import cluster_settings
    big = cluster_settings(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 50 * 8000
    small = cluster_settings(10 * 2**20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(128 << 20)


def test_largest_group(spark):
    from tablewright.order import largest_group
    df = spark.range(100).selectExpr("id % 3 AS k", "id")
    assert largest_group(df, ["k"], 10) == 34
    assert largest_group(df, [], 10) == 11  # stops after limit + 1 rows


def test_json_records(spark):
    import json
    from tablewright.sources.files import to_json_records
    df = spark.createDataFrame([(1, "a", None)], "k int, s string, x double")
    rec = json.loads(to_json_records(df).first().record)
    assert rec == {"k": 1, "s": "a"}
