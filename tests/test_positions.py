"""Positions kept beside a table: further positional operators do not sort again."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright import order
from tablewright.operators import cleaning as K
from tablewright.operators import joins as J
from tablewright.operators import selection as S
from tablewright.plans.steps import run_steps


@pytest.fixture
def table(many_files):
    spark = many_files
    rng = random.Random(3)
    rows = [(i, rng.choice([None, float(rng.randrange(50))]), rng.choice("ab")) for i in range(400)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k long, v double, g string").repartition(6), pd.DataFrame(sorted(rows), columns=["k", "v", "g"])


@pytest.fixture
def sorts(monkeypatch):
    """The sorted tables that are written."""
    made = []
    real = order._frozen_positions
    monkeypatch.setattr(order, "_frozen_positions", lambda *a: made.append(a) or real(*a))
    return made


def answer(df):
    return [tuple(r) for r in df.orderBy("k").collect()]


def rows_of(p):
    return [tuple(None if x != x else x for x in r) for r in p.itertuples(index=False)]


def test_three_positional_steps_sort_once(spark, table, sorts):
    df, p = table
    args = {"order_by": ["k"]}
    env = run_steps({"current": df}, [
        {"op": "slice_rows", "args": {"start": 10, "end": -20, "step": 3, **args}},
        {"op": "drop_rows", "args": {"indices": [0, 5, -1, 5], **args}},
        {"op": "fill_missing", "args": {"method": "ffill", "columns": ["v"], **args}},
        {"op": "slice_rows", "args": {"start": 4, "end": 60, **args}},
        {"op": "fill_missing", "args": {"method": "bfill", "columns": ["v"], **args}}])
    want = p.iloc[10:-20:3].reset_index(drop=True)
    want = want.drop([0, 5, len(want) - 1]).reset_index(drop=True)
    want["v"] = want["v"].ffill()
    want = want.iloc[4:60].copy()
    want["v"] = want["v"].bfill()
    assert answer(env["current"]) == rows_of(want)
    assert len(sorts) == 1
    assert "rangepartitioning" not in env["current"]._jdf.queryExecution().executedPlan().toString()


def test_indexed_table_serves_many_operators(spark, table, sorts):
    df, p = table
    t = order.index_table(df, "k")
    assert answer(S.slice_rows(t, 3, 9, order_by="k")) == rows_of(p.iloc[3:9])
    assert answer(S.slice_rows(t, None, None, -7, order_by="k")) == rows_of(p.iloc[::-7].sort_values("k"))
    assert answer(K.drop_positions(t, [1, 399], ["k"])) == rows_of(p.drop([1, 399]))
    other = S.slice_rows(t, 100, 300, order_by="k").select(F.col("k").alias("k2"))
    both = J.concat_tables([t, S.slice_rows(t, 100, 300, order_by="k").withColumnsRenamed({c: c + "2" for c in "kvg"})],
                           axis=1, order_by=[["k"], ["k2"]])
    assert {(r["k"], r["k2"]) for r in both.collect()} == {(i, i + 100 if i < 200 else None) for i in range(400)}
    assert other.count() == 200 and len(sorts) == 2  # the renamed table does not carry the order's column


def test_slices_open_only_their_files(spark, table):
    df, p = table
    t = order.index_table(df, "k")
    files = len(t.inputFiles())
    part = S.slice_rows(t, 5, 7, order_by="k")
    assert answer(part) == rows_of(p.iloc[5:7])
    assert files > 1 and len(part.inputFiles()) == 1
    again = S.slice_rows(S.slice_rows(t, 50, 350, 2, order_by="k"), 100, 103, order_by="k")
    assert answer(again) == rows_of(p.iloc[50:350:2].iloc[100:103]) and len(again.inputFiles()) <= 2
    assert answer(S.slice_rows(t, 500, 600, order_by="k")) == []


def test_another_order_or_a_filled_key_sorts_again(spark, table, sorts):
    df, p = table
    t = order.index_table(df, ["g", "k"])
    assert answer(S.slice_rows(t, 0, 4, order_by="k")) == rows_of(p.iloc[:4]) and len(sorts) == 2
    filled = K.fill_missing(order.index_table(df, ["v", "k"]), method="ffill", columns=["v"], order_by=["v", "k"])
    assert order.positions_of(filled, ["v", "k"]) is None
    assert order.positions_of(df.filter("k > 3"), ["k"]) is None


def test_order_by_expressions_and_empty_tables(spark, table, sorts):
    df, p = table
    got = K.fill_missing(df, method="ffill", columns=["v"], order_by=[F.col("k").desc()])
    want = p.iloc[::-1].copy()
    want["v"] = want["v"].ffill()
    assert answer(got) == rows_of(want.iloc[::-1]) and len(sorts) == 1
    none = order.index_table(df.limit(0), "k")
    assert S.slice_rows(none, 0, 5, order_by="k").collect() == []
    assert K.fill_missing(none, method="bfill", columns=["v"], order_by="k").collect() == []
