"""Answers on inputs that the registered tables lack: nulls, NaN, dots, quoted @, mixed types."""

import datetime as dt

import pytest

from tablewright.operators import analytics as W
from tablewright.operators import charts as C
from tablewright.operators import cleaning as K
from tablewright.operators import selection as S
from tablewright.operators import transform as X
from tablewright.schema import OperatorError


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_variables_not_in_quoted_text(spark):
    df = spark.createDataFrame([("a@b", 1), ("c", 2)], "s string, n int")
    assert S.filter_rows(df, "s = 'a@b'").count() == 1
    assert S.filter_rows(df, "s = 'a@b' AND n = @k", {"k": 1}).count() == 1
    with pytest.raises(OperatorError):
        S.filter_rows(df, "n = @k")


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", None), (2, "c", 7.0)], "k int, `x.y` string, `v.w` double")
    assert K.drop_duplicates(df, ["k"], order_by=["x.y"]).count() == 2
    assert K.drop_duplicates(df, ["k"], keep=False).count() == 1
    assert W.best_row_per_group(df, "k", "v.w").count() == 2
    assert rows(K.fill_missing(df, methods={"v.w": "ffill"}, order_by="x.y").select("`v.w`")) == [(5.0,), (5.0,), (7.0,)]


def test_best_row_ties_on_text_and_dates(spark):
    d = [dt.date(2020, 1, 1), dt.date(2021, 1, 1)]
    df = spark.createDataFrame([("g", 1, "b", d[1]), ("g", 1, "a", d[1]), ("g", 0, "c", d[0])], "g string, v int, t string, d date")
    assert W.best_row_per_group(df, "g", "v", tie_break="t").first().t == "a"
    assert W.best_row_per_group(df, "g", "d", tie_break="t").first().t == "a"


def test_fill_precedence_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None)], "i int, y double")
    assert rows(K.fill_missing(df, method="mean", columns=["y"]).select("y")) == [(3.0,)] * 3
    assert rows(K.fill_missing(df, value=0, methods={"y": "mean"}, columns=["y"]).select("y")) == [(0.0,), (0.0,), (3.0,)]


def test_scaling_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "i int, y double")
    for method in ("standard", "minmax", "robust"):
        assert rows(X.scale_numeric(df, ["y"], method).select("y")) == [(0.0,), (0.0,)]


def test_replacement_rules(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cd")], "n int, s string")
    assert rows(K.replace_values(df, {"n": {1: "one"}}).select("n")) == [("2",), ("one",)]
    with pytest.raises(OperatorError):
        K.replace_values(df, {"n": {None: 1}})
    out = K.replace_values(df, {"s": {r"(.)(.)": r"\2\1"}}, regex=True)
    assert rows(out.select("s")) == [("ba",), ("dc",)]


def test_charts_drop_null_groups_and_sum_nothing_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0), ("b", None)], "x string, y double")
    assert rows(C.chart_data(df, "bar", "x", "y", "sum")) == [("a", 1.0), ("b", 0.0)]
    assert rows(C.fallback_groups(df, "x")) == [("a", 1), ("b", 1)]
    assert rows(C.chart_data(df, "bar", "x", "y", "median")) == [("a", 1.0), ("b", None)]


def test_heatmap_rules(spark):
    df = spark.createDataFrame([("a", "p", 1.0, 2.0), ("a", "q", 2.0, 4.0), ("b", "p", 3.0, 5.0)], "c string, d string, u double, v double")
    assert set(C.heatmap_data(df, ["c", "d", "u", "v"]).columns) >= {"col_x", "col_y", "r"}
    assert rows(C.heatmap_data(df, x="c", y="d")) == [("a", 2), ("b", 1)]


def test_chart_checks(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "t", 1.0)], "d date, s string, v double")
    assert C.compatibility(df, "line", "d", "v").first().ok and C.compatibility(df, "line", "v", "d").first().ok
    assert not C.compatibility(df, "line", "s", "v").first().ok
    n = {9: "pie", 10: None}
    for k, want in n.items():
        t = spark.range(200).selectExpr(f"cast(id % {k} as string) AS s", "cast(id as double) AS v")
        assert ("pie" in {r.chart for r in C.recommend_charts(t).collect()}) == (want == "pie")
        assert "bar" in {r.chart for r in C.recommend_charts(t).collect()}


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "i int, g string")
    with pytest.raises(OperatorError):
        S.sample_rows(df, n=50, key="i").count()
    out = S.sample_rows(df, n=4, by="g", replace=True, key="i")
    assert sorted(r.g for r in out.collect()) == ["a"] * 4 + ["b"] * 4
    assert rows(out) == rows(S.sample_rows(df.repartition(4), n=4, by="g", replace=True, key="i"))
