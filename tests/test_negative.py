"""Bad arguments fail before any job runs, with a clear message."""

import pytest

from tablewright.operators import aggregate as A
from tablewright.operators import joins as J
from tablewright.operators import selection as S
from tablewright.operators import transform as X
from tablewright.schema import OperatorError


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, s string, v double")


def test_unknown_column(df):
    with pytest.raises(OperatorError, match="not found"):
        S.select_columns(df, ["nope"])


def test_unknown_aggregate(df):
    with pytest.raises(OperatorError, match="Unsupported"):
        A.group_by_agg(df, "s", {"v": "variance"})


def test_empty_by_and_agg(df):
    with pytest.raises(OperatorError):
        A.group_by_agg(df, [], {"v": "sum"})
    with pytest.raises(OperatorError):
        A.group_by_agg(df, "s", {})


def test_ascending_length(df):
    with pytest.raises(OperatorError, match="ascending"):
        S.sort_data(df, ["k", "s"], [True])


def test_unknown_function(df):
    with pytest.raises(OperatorError):
        X.apply_custom(df, "v", "cube")


def test_bad_predicate(df):
    with pytest.raises(Exception):
        S.filter_rows(df, "v >>> 2")
    with pytest.raises(Exception):
        S.filter_rows(df, "missing_col > 2")


def test_rename_duplicates_and_clash(df):
    with pytest.raises(OperatorError):
        S.rename_columns(df, {"k": "x", "s": "x"})
    with pytest.raises(OperatorError):
        S.rename_columns(df, {"k": "s"})


def test_n_and_frac(df):
    with pytest.raises(OperatorError):
        S.sample_rows(df, n=1, frac=0.5)


def test_label_count(df):
    with pytest.raises(OperatorError):
        X.bin_numeric(df, "v", 3, labels=["a", "b"])


def test_key_types_differ(spark, df):
    other = spark.createDataFrame([("1",)], "k string")
    with pytest.raises(OperatorError, match="types differ"):
        J.merge_tables(df, other, on="k")


def test_stack_needs_two_tables(df):
    with pytest.raises(OperatorError):
        J.concat_tables([df])


def test_stack_checks_column_order(df):
    with pytest.raises(OperatorError):
        J.concat_tables([df, df.select("s", "k", "v")])


def test_on_excludes_left_right(df):
    with pytest.raises(OperatorError):
        J.merge_tables(df, df, on="k", left_on="k", right_on="k")


def test_cross_join_without_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([("p",), ("q",), ("r",)], "y string")
    assert J.merge_tables(a, b, "cross").count() == 6
    with pytest.raises(OperatorError):
        J.merge_tables(a, b, "cross", on="x")


def test_variables_missing(df):
    with pytest.raises(OperatorError):
        S.filter_rows(df, "v > @lim")
