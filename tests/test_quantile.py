"""Quantiles from cumulated value counts equal pandas', with and without groups."""

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import aggregate as A
from tablewright.operators import quantile as Q

from conftest import SF001

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_whole_table_equals_pandas(many_files):
    li = many_files.read.parquet(f"{SF001}/lineitem.parquet")
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    got = {(r["column"], r["q"]): r["value"] for r in Q.quantile_table(li, cols, QS).collect()}
    pdf = li.select(cols).toPandas()
    assert got.keys() == {(c, q) for c in cols for q in QS}
    for (c, q), v in got.items():
        assert v == pytest.approx(pdf[c].quantile(q), rel=1e-12, abs=1e-9)


def test_grouped_equals_pandas_with_nulls(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 500), "v": rng.integers(0, 9, 500).astype(float)})
    pdf.loc[pdf.index % 7 == 0, "v"] = np.nan
    pdf.loc[pdf.g == "c", "v"] = np.where(pdf.loc[pdf.g == "c", "v"].isna(), np.nan, 4.0)
    df = spark.createDataFrame([(g, None if np.isnan(v) else v) for g, v in pdf.itertuples(index=False)]
                               + [(None, 1.0), ("none", None)], "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in Q.quantile_table(df, ["v"], QS, by="g").collect()}
    assert got == {(g, q): pytest.approx(x.v.quantile(q)) for g, x in pdf.groupby("g") for q in QS}
    med = {r["g"]: r["v"] for r in A.group_by_agg(df, "g", {"v": "median"}).collect()}
    assert med == {**{g: pytest.approx(x.v.median()) for g, x in pdf.groupby("g")}, "none": None}


def test_empty_column_and_describe(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert Q.quantile_values(df, ["a", "b"], [0.5]) == {"a": [1.5], "b": [None]}
    rows = {r.column: r for r in A.describe_stats(df).collect()}
    assert rows["a"].p25 == pytest.approx(1.25) and rows["b"].p50 is None


def test_hot_value_is_one_row(spark):
    """60 % equal values: the cumulated table has one row a distinct value."""
    df = spark.range(20_000).selectExpr("cast(if(id % 5 < 3, 7, id) as double) AS v")
    want = df.toPandas().v.quantile([0.25, 0.5, 0.75]).tolist()
    assert Q.quantile_values(df, ["v"], [0.25, 0.5, 0.75])["v"] == pytest.approx(want)


@pytest.mark.parametrize("limit, small", [(10, 10), (200, 0), (200_000, 4000)])
def test_brackets_are_narrowed(spark, monkeypatch, limit, small):
    """Tiny limits force narrowing; hot values, NaN and infinities keep their ranks."""
    monkeypatch.setattr(Q, "LIMIT", limit)
    monkeypatch.setattr(Q, "SMALL", small)
    if limit < 200:
        monkeypatch.setattr(Q, "MARGIN", 0.0)  # brackets that miss their rank are opened
    df = spark.range(30_000).selectExpr(
        "id % 4 AS g", "CAST(CASE WHEN id % 3 = 0 THEN 5 WHEN id % 1000 = 1 THEN NULL ELSE (id * 7919) % 30011 END AS double) AS a",
        "CAST(IF(id % 2 = 0, 1, 2) AS double) AS b", "CAST(id * id % 10007 AS int) AS c")
    pdf = df.toPandas()
    got = {(r["column"], r["q"]): r["value"] for r in Q.quantile_table(df, ["a", "b", "c"], QS).collect()}
    assert got == {(c, q): pytest.approx(pdf[c].quantile(q), rel=1e-12) for c in "abc" for q in QS}
    by = {(r["g"], r["column"], r["q"]): r["value"] for r in Q.quantile_table(df, ["a", "b", "c"], QS, by="g").collect()}
    assert by == {(g, c, q): pytest.approx(x[c].quantile(q), rel=1e-12) for g, x in pdf.groupby("g") for c in "abc" for q in QS}


def test_odd_doubles(spark):
    values = [float("inf"), float("-inf"), 0.0, -0.0, 1.5, None, 1e300] * 3
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    got = Q.quantile_values(df, ["v"], [0.0, 1.0, 6 / 17])["v"]
    assert got == [known[0], known[-1], known[6]]


def test_quantiles_sort_and_write_nothing(spark, tmp_path):
    """The plan of a whole-table quantile holds no range sort, and scratch stays empty."""
    import os
    df = spark.range(50_000).selectExpr("cast(id * 31 % 50021 as double) AS v")
    root = spark.sparkContext.getCheckpointDir() or ""
    before = sum(len(f) for *_, f in os.walk(root.removeprefix("file:")))
    Q.quantile_values(df, ["v"], [0.25, 0.5])
    assert sum(len(f) for *_, f in os.walk((spark.sparkContext.getCheckpointDir() or "").removeprefix("file:"))) == before
    plan = Q.quantile_table(df.withColumn("g", df.v % 3), ["v"], [0.5], by="g")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
