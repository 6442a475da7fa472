"""Hand-made cases of FIXTURES.md section 3, one test each (numbers match)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import analytics as W
from tablewright.operators import cleaning as K
from tablewright.operators import joins as J
from tablewright.operators import selection as S
from tablewright.operators import transform as X
from tablewright.schema import OperatorError


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def seq(spark, values, typ="double"):
    """A one-column table with an explicit row id for order-based operators."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, a {typ}")


def col_values(df, c="a", order="id"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_01_ne_keeps_null(spark):
    out = S.filter_rows(seq(spark, [1.0, 2.0, None]), S.ne_keep_null("a", 1.0))
    assert col_values(out) == [2.0, None]


def test_02_drop_condition_keeps_null(spark):
    out = K.drop_rows(seq(spark, [1.0, 2.0, None]), condition="a > 1")
    assert col_values(out) == [1.0, None]


def test_03_drop_positions(spark):
    out = K.drop_rows(seq(spark, [1.0, 2.0, 3.0]), indices=[-1, 0], order_by="id")
    assert col_values(out) == [2.0]


def test_03b_drop_positions_out_of_range(spark):
    with pytest.raises(Exception):
        K.drop_rows(seq(spark, [1.0, 2.0, 3.0]), indices=[5], order_by="id").collect()


def test_04_keep_none(spark):
    df = seq(spark, [1.0, 1.0, None, None, 2.0])
    out = K.drop_rows(df, subset=["a"], keep=False)
    assert [r.a for r in out.collect()] == [2.0]


def test_05_interpolate_linear(spark):
    df = seq(spark, [None, 1.0, None, 3.0, None])
    out = K.fill_missing(df, methods={"a": "interpolate"}, order_by="id")
    assert col_values(out) == [None, 1.0, 2.0, 3.0, 3.0]


def test_06_null_group_key_dropped(spark):
    df = frame(spark, [("a", 1.0), (None, 2.0)], "k string, v double")
    out = A.group_by_agg(df, "k", {"v": "sum"}).collect()
    assert [(r.k, r.v) for r in out] == [("a", 1.0)]


def test_07_sum_of_all_null_is_zero(spark):
    df = frame(spark, [(1, None)], "k int, v double")
    assert A.group_by_agg(df, "k", {"v": "sum"}).first().v == 0.0


def test_08_adjusted_skewness(spark):
    df = seq(spark, [1.0, 2.0, 3.0, 10.0])
    v = df.agg(A.adjusted_skewness(F.col("a"))).first()[0]
    assert v == pytest.approx(1.763632614803888, rel=1e-12)


def test_09_quartiles(spark):
    out = A.quantiles(seq(spark, [1.0, 2.0, 3.0, 10.0]), ["a"], (0.25, 0.5, 0.75)).orderBy("q").collect()
    assert [r.value for r in out] == [1.75, 2.5, 4.75]


def test_10_mode_smallest_tie(spark):
    assert A.mode_value(seq(spark, [2.0, 1.0, 1.0, 2.0]), ["a"]).first().a == 1.0


def test_11_null_keys_match(spark):
    left = frame(spark, [("a",), (None,)], "k string")
    right = frame(spark, [("a", 1), (None, 2)], "k string, v int")
    assert J.merge_tables(left, right, on="k").count() == 2


def test_12_concat_columns(spark):
    a = spark.createDataFrame([(1,), (2,)], "a int")
    b = spark.createDataFrame([(3,)], "b int")
    out = J.concat_tables([a, b], axis=1, join="outer", order_by=["a", "b"]).orderBy("index").collect()
    assert [(r.a, r.b) for r in out] == [(1, 3), (2, None)]


def test_13_replace_no_chaining(spark):
    df = frame(spark, [("a",), ("b",)], "s string")
    out = K.replace_values(df, {"s": {"a": "b", "b": "c"}})
    assert sorted(r.s for r in out.collect()) == ["b", "c"]


def test_14_replace_ignore_case_inside(spark):
    df = frame(spark, [("dellX",), ("DELL",)], "s string")
    out = K.replace_values(df, {"s": {"dell": "Dell"}}, case_insensitive=True)
    assert sorted(r.s for r in out.collect()) == ["Dell", "DellX"]


def test_15_text_key_on_number_column(spark):
    df = frame(spark, [(1000,), (2,)], "n long")
    out = K.replace_values(df, {"n": {"1000": "x"}})
    assert sorted(r.n for r in out.collect()) == [2, 1000]


def test_16_title_case(spark):
    df = frame(spark, [("o'neil-smith 3com ÉCOLE",)], "s string")
    assert K.clean_strings(df, "s", "title").first().s == "O'Neil-Smith 3Com École"


def test_17_strip_unicode_space(spark):
    df = frame(spark, [("\ta b\n",), (" x　",)], "s string")
    assert sorted(r.s for r in K.clean_strings(df, "s", "strip").collect()) == ["a b", "x"]


def test_18_round_half_even(spark):
    df = seq(spark, [0.5, 1.5, 2.5])
    assert col_values(X.apply_custom(df, "a", "round")) == [0.0, 2.0, 2.0]


def test_19_divide_by_zero_is_null(spark):
    df = frame(spark, [(1, 0.0, 0), (2, 2.0, 2)], "id long, a double, b int")
    out = X.create_interaction(df, "a", "b", "r", "divide")
    assert [r.r for r in out.orderBy("id").collect()] == [None, 1.0]


def test_20_equal_width_bins(spark):
    df = seq(spark, [0.0, 1.0, 2.0, 10.0])
    out = X.bin_numeric(df, "a", 4)
    assert col_values(out, "a_bin") == [1, 1, 1, 4]
    edges = X.bin_edges(df, "a", 4)
    assert edges == pytest.approx([-0.01, 2.5, 5.0, 7.5, 10.0])


def test_21_constant_column_bins(spark):
    df = seq(spark, [5.0, 5.0])
    out = X.bin_numeric(df, "a", 2)
    assert col_values(out, "a_bin") == [1, 1]
    assert col_values(out, "a_binned")[0] == "(4.995, 5]"


def test_22_quantile_bins(spark):
    df = seq(spark, [float(i) for i in range(1, 9)])
    assert col_values(X.bin_numeric(df, "a", 4, qcut=True), "a_bin") == [1, 1, 2, 2, 3, 3, 4, 4]
    assert X.bin_edges(df, "a", 4, qcut=True)[1:4] == pytest.approx([2.75, 4.5, 6.25])


def test_23_repeated_quantile_edges(spark):
    with pytest.raises(OperatorError):
        X.bin_numeric(seq(spark, [1.0, 1.0, 1.0, 1.0, 2.0]), "a", 4, qcut=True)


def test_24_date_features(spark):
    df = spark.createDataFrame([(0, dt.datetime(2024, 1, 6)), (1, None)], "id long, d timestamp_ntz")
    out = X.create_date_features(df, "d", ["weekday", "is_weekend"]).orderBy("id").collect()
    assert (out[0].d_weekday, out[0].d_is_weekend) == (5, True)
    assert (out[1].d_weekday, out[1].d_is_weekend) == (None, False)


def test_25_one_hot(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "id long, c string")
    out = X.one_hot_encode(df, "c").orderBy("id").collect()
    assert [r.c_a for r in out] == [False, True, False]
    assert [r.c_b for r in out] == [True, False, False]
    first = X.one_hot_encode(df, "c", drop_first=True)
    assert "c_a" not in first.columns and "c_b" in first.columns


def test_26_unpivot_mixed_types(spark):
    df = spark.createDataFrame([(1, 3, "x"), (2, 4, "y")], "i int, a int, b string")
    out = X.melt_unpivot(df, "i").collect()
    assert sorted((r.i, r.variable, r.value) for r in out) == [
        (1, "a", "3"), (1, "b", "x"), (2, "a", "4"), (2, "b", "y")]


def test_27_pivot_mean(spark):
    df = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 3.0), (None, "p", 4.0)],
                               "i string, c string, v double")
    out = {r.i: (r.p, r.q) for r in X.pivot_table(df, "i", "c", "v").collect()}
    assert out == {"x": (1.0, 2.0), "y": (3.0, None)}


def test_28_growth_pct(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([100.0, 110.0, 0.0, 5.0])], "t int, v double")
    out = [r.growth_pct for r in W.growth_pct(df, "t", "v").orderBy("t").collect()]
    assert out[0] == 0.0 and out[1] == pytest.approx(10.0) and out[2] == pytest.approx(-100.0)
    assert out[3] is None


def test_29_best_row_all_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    assert [r.g for r in W.best_row_per_group(df, "g", "v").collect()] == ["a"]


def test_30_top_ties_keep_first(spark):
    df = seq(spark, [5.0, 5.0, 5.0, 1.0])
    out = S.nlargest(df, 2, "a", tie_break="id")
    assert sorted(r.id for r in out.collect()) == [0, 1]


def test_31_fraction_sample_size(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    assert S.sample_rows(df, frac=0.1, random_state=1, key="k").count() == 2


def test_32_between_excludes_null(spark):
    df = seq(spark, [1.0, None])
    assert col_values(df.filter(S.range_predicate("a", 0, 2))) == [1.0]


def test_33_clamp(spark):
    out = seq(spark, [1.0, 9.0, None]).withColumn("a", K.clamp(F.col("a"), 2.0, 5.0))
    assert col_values(out) == [2.0, 5.0, None]


def test_34_constant_column_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert A.corr_pair(df, "x", "y").first().r is None


def test_35_number_family(spark):
    df = spark.createDataFrame([(1, 1.0, True, "s", dt.datetime(2020, 1, 1))],
                               "i int, d double, b boolean, s string, t timestamp")
    assert S.select_columns(df, dtypes=["number"]).columns == ["i", "d"]


def test_36_csv_bad_rows(spark, tmp_path):
    from tablewright.sources.files import read_csv
    p = tmp_path / "bad.csv"
    p.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,x,12\n16,,18\n")
    out = read_csv(spark, str(p))
    rows = sorted((r.a, r.b, r.c) for r in out.collect())
    assert rows == [(1, "2", 3), (4, "5", None), (10, "x", 12), (16, None, 18)]
    assert dict(out.dtypes)["b"] == "string"


def test_37_agg_names(spark):
    df = seq(spark, [1.0, 2.0])
    assert A.group_by_agg(df, "id", {"a": ["sum", "mean"]}).columns == ["id", "a_sum", "a_mean"]
    assert A.group_by_agg(df, "id", {"a": "sum"}).columns == ["id", "a"]


def test_38_describe(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x")], "a double, s string")
    rows = {r.column: r for r in A.describe_stats(df).collect()}
    a, s = rows["a"], rows["s"]
    assert (a["count"], a.mean, a["min"], a.p25, a.p50, a.p75, a["max"]) == (2, 1.5, 1.0, 1.25, 1.5, 1.75, 2.0)
    assert a.std == pytest.approx(math.sqrt(0.5))
    assert (s["count"], s.unique, s.top, s.freq) == (2, 1, "x", 2)
