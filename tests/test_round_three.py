"""Funnels by composed maps, wide and sparse pivots, sketched top categories, profiles."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import analytics as W
from tablewright.operators import charts as C
from tablewright.operators import transform as X
from tablewright.schema import OperatorError

from conftest import SF001


def slow_funnel(events, steps):
    out = [0] * len(steps)
    for u in {u for u, _, _ in events if u is not None}:
        at = None
        for i, s in enumerate(steps):
            times = [t for v, t, e in events if v == u and t is not None and e == s and (at is None or t >= at)]
            if not times:
                break
            at = min(times)
            out[i] += 1
    return out


@pytest.mark.parametrize("block", ["minute", "hour", "year"])
def test_funnel_equals_brute_force(spark, block):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    events = [(rng.choice([1, 2, 3, 4, 5, 6, 7, None]), start + timedelta(seconds=30 * rng.randrange(400)), rng.choice("abcdx")) for _ in range(260)]
    events += [(9, start + timedelta(seconds=i), rng.choice("ab")) for i in range(500)] + [(1, None, "a"), (2, start, None)]
    df = spark.createDataFrame(events, "u int, t timestamp_ntz, e string").repartition(5)
    for steps in (["a", "b"], ["a", "a", "b", "c", "d", "a", "b"], ["d", "c", "b", "a"], ["zz", "a"]):
        out = W.funnel(df, "u", "t", "e", steps, block=block).orderBy("step_index").collect()
        assert [(r.step, r.users) for r in out] == list(zip(steps, slow_funnel(events, steps)))
    assert [r.users for r in W.funnel(df.limit(0), "u", "t", "e", ["a", "b"]).collect()] == [0, 0]


def test_funnel_is_one_scan(spark):
    e = spark.read.parquet(f"{SF001}/events.parquet")
    plan = W.funnel(e, "user_id", "ts", "event_type", ["view", "click", "purchase", "view", "error"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_pivot_of_two_columns_and_cells(spark):
    rows = [("x", "a`", "p.q", 1.0), ("x", "a`", "r", 3.0), ("y", "b", "r", None), ("y", "a`", "r", 5.0), ("y", "a`", "r", 7.0), (None, "b", "r", 1.0), ("y", None, "r", 1.0)]
    df = spark.createDataFrame(rows, "i string, c1 string, `c 2` string, v double")
    out = X.pivot_table(df, "i", ["c1", "c 2"], values="v", aggfunc="mean")
    assert out.columns == ["i", "a`_p.q", "a`_r", "b_r"]
    assert sorted(map(tuple, out.collect())) == [("x", 1.0, 3.0, None), ("y", None, 6.0, None)]
    med = X.pivot_table(df, "i", ["c1", "c 2"], values=["v"], aggfunc="median")
    assert med.columns[1:] == ["v_a`_p.q", "v_a`_r", "v_b_r"]
    assert sorted(map(tuple, med.collect())) == [("x", 1.0, 3.0, None), ("y", None, 6.0, None)]
    cells = X.pivot_cells(df, "i", ["c1", "c 2"], "v", "sum")
    assert sorted(map(tuple, cells.collect())) == [("x", "a`", "p.q", 1.0), ("x", "a`", "r", 3.0), ("y", "a`", "r", 12.0), ("y", "b", "r", 0.0)]


def test_many_pivot_values(spark):
    df = spark.range(60_000).selectExpr("id % 50000 AS k", "id % 3 AS i", "id AS v")
    with pytest.raises(OperatorError):
        X.pivot_table(df, "i", "k", "v", "sum")
    with pytest.raises(OperatorError):
        X.one_hot_encode(df, "k", max_columns=100)
    assert X.pivot_cells(df, "i", "k", "v", "sum").count() == df.select("i", "k").distinct().count()
    codes, cells = X.one_hot_sparse(df, "k", key="v")
    assert codes.count() == 50_000 and codes.where("code <> value").count() == 0
    assert cells.where("code <> v % 50000").count() == 0 and cells.count() == 60_000


def test_sketched_top_categories(spark):
    """Skewed and flat columns, nulls, fewer values than asked for: always the exact counts."""
    df = spark.range(50_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'big' WHEN id % 7 = 0 THEN NULL ELSE cast(id % 5000 as string) END AS a",
                                        "cast(id as string) AS flat", "id % 3 AS few", "cast(NULL as string) AS none")
    for approx in (True, False):
        got = A.top_categories(df, ["a", "flat", "few", "none"], 4, approx=approx).collect()
        want = A.top_values(df, ["a", "flat", "few", "none"], 4).collect()
        assert sorted((r["column"], r["rank"], r["value"], r["count"]) for r in got) == sorted((r["column"], r["rank"], r["value"], r["count"]) for r in want)


def test_profile_has_top_and_strong_pairs(spark):
    df = spark.range(1000).selectExpr("id AS a", "-id + id % 3 AS b", "id * 7919 % 1009 AS c", "cast(1 as int) AS d", "cast(id % 4 as string) AS s",
                                      "CASE WHEN id % 5 > 0 THEN id * 2.0 END AS e")
    exact = {r["column"]: r for r in A.chart_stats(df, top_k=3).collect()}
    pdf = df.toPandas().astype({"e": float})
    assert [(x["value"], x["count"]) for x in exact["s"]["top"]] == [("0", 250), ("1", 250), ("2", 250)] and exact["a"]["top"] is None
    assert {(c, x["column"]): pytest.approx(x["r"]) for c in exact for x in exact[c]["strong"] or []} == {
        (x, y): pdf[x].corr(pdf[y]) for x, y in (("a", "b"), ("a", "e"), ("b", "e"))}
    assert exact["c"]["n_distinct"] == pdf.c.nunique() and exact["c"]["median"] == pytest.approx(pdf.c.median())
    near = {r["column"]: r for r in A.chart_stats(df, top_k=3, approx=True).collect()}
    assert near["s"]["top"] == exact["s"]["top"] and abs(near["c"]["n_distinct"] - exact["c"]["n_distinct"]) < 100


def test_corr_matrix_equals_pandas(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1), (2.0, 4.0, 5.0, 3), (None, 1.0, 5.0, 2), (3.0, None, 5.0, 9), (4.0, 1.0, 5.0, -4)], "a double, b double, c double, d int")
    pdf = df.toPandas()
    for r in A.corr_matrix(df).collect():
        want = pdf[r.col_x].corr(pdf[r.col_y])
        assert r.r == pytest.approx(want) if want == want else r.r is None
    assert all(r.r is None for r in A.corr_matrix(df.limit(1)).collect() + A.corr_matrix(df.limit(0)).collect())


def test_heatmap_and_area_rules(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "n int, s string, v double")
    assert C.compatibility(df, "area", "s", "v").first().ok and not C.compatibility(df, "area", "n", "s").first().ok
    assert not C.compatibility(df, "heatmap").first().ok and C.compatibility(df, "heatmap", columns=["n", "s"]).first().ok
    assert "nope" in C.compatibility(df, "heatmap", columns=["n", "nope"]).first().reason
    assert C.compatibility(df.select("n", F.lit("x").alias("s")), "correlation").first().ok is False


def test_names_are_resolved_outside_quotes():
    from tablewright.operators.selection import predicate_text as text
    names = {"Ab": "Ab", "x y": "x y", "N": "N", "n": "n"}
    assert text("aB = 'aB' AND `X Y` > 1", names=names) == "`Ab` = 'aB' AND `x y` > 1"
    assert text("N = n AND upper(AB) LIKE 'a''ab' or not ab in (1)", names=names) == "`N` = `n` AND upper(`Ab`) LIKE 'a''ab' or not `Ab` in (1)"
    assert text("ab = @ab", {"ab": "it's"}, names) == "`Ab` = 'it\\'s'"
    assert text("zz = 1 AND t.ab = 2", names=names) == "zz = 1 AND t.ab = 2"
    assert text("V = 1", names={"v": "v", "V ": "V "}) == "`v` = 1" and text("AB > 1", names={"ab": "p", "aB": "q"}) == "AB > 1"


def test_columns_that_differ_in_case(spark):
    from tablewright.operators.selection import filter_rows
    df = spark.createDataFrame([(1, 5), (5, 1)], "a int, b int").toDF("v", "V")
    assert [tuple(r) for r in filter_rows(df, "v > 2").collect()] == [(5, 1)]
    assert [tuple(r) for r in filter_rows(df, "V > 2 AND v < 2").collect()] == [(1, 5)]
    with pytest.raises(Exception):
        filter_rows(df.toDF("ab", "AB"), "Ab > 1").collect()


def test_statistics_steps_run_their_ancestors_once(spark):
    """Three steps that need statistics: the first step's rows are computed once."""
    from tablewright.plans.steps import run_steps
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = spark.range(500).selectExpr("id", "IF(id % 9 = 0, NULL, cast(id % 50 as double)) AS v")
    reg = {"slow": lambda df: df.mapInArrow(count, df.schema)}
    from tablewright.plans import steps
    out = run_steps({"current": source}, [{"op": "slow"}, {"op": "fill_missing", "args": {"method": "median", "columns": ["v"]}},
                                          {"op": "remove_outliers", "args": {"columns": ["v"], "method": "iqr"}},
                                          {"op": "scale_numeric", "args": {"columns": ["v"], "method": "robust"}}], {**steps.REGISTRY, **reg})["current"]
    assert out.count() == 500 and seen.value == 500


def test_nan_is_null_at_load(spark, tmp_path):
    from tablewright.sources.files import load_tables, read_table
    spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double").write.parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, f"{tmp_path}/t.parquet").where("v IS NULL").count() == 2
    assert load_tables(spark, str(tmp_path))["t"].where("v IS NULL").count() == 2
    assert read_table(spark, f"{tmp_path}/t.parquet", nan_to_null=False).where("v IS NULL").count() == 1
