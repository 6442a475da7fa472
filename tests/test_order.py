"""Positions, carries, blocked windows: compared with brute force on many files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import analytics as W
from tablewright.operators import cleaning as K
from tablewright.operators import selection as S
from tablewright.order import POS, group_rank, with_position

from conftest import SF001


def nn(series):
    """Values with NaN/None both as None."""
    return [None if (x is None or x != x) else x for x in series.tolist()]


@pytest.fixture
def events(many_files):
    return many_files.read.parquet(f"{SF001}/events.parquet")


def test_position_is_exact_across_files(events):
    pos = with_position(events, ["value", "event_id"], name="p", total="n")
    rows = pos.select("event_id", "value", "p", "n").toPandas()
    expect = rows.sort_values(["value", "event_id"]).reset_index(drop=True)
    assert list(expect["p"]) == list(range(len(expect)))
    assert set(rows["n"]) == {len(rows)}


def test_position_spans_several_files(many_files, events):
    from tablewright.order import freeze
    sorted_tbl = freeze(events.orderBy("event_id"), "test")
    files = sorted_tbl.select(F.col("_metadata.file_name")).distinct().count()
    assert files > 1


def test_ffill_bfill_across_blocks(many_files):
    e = many_files.read.parquet(f"{SF001}/events.parquet").select(
        "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    pdf = e.toPandas().sort_values("event_id").reset_index(drop=True)
    f = K.fill_missing(e, method="ffill", order_by="event_id").toPandas()
    b = K.fill_missing(e, method="bfill", order_by="event_id").toPandas()
    assert nn(f.sort_values("event_id")["value"]) == nn(pdf["value"].ffill())
    assert nn(b.sort_values("event_id")["value"]) == nn(pdf["value"].bfill())


def test_interpolate_matches_pandas(many_files):
    e = many_files.read.parquet(f"{SF001}/events.parquet").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    pdf = e.toPandas().sort_values("event_id").reset_index(drop=True)
    exp = pdf["value"].interpolate(method="linear").tolist()
    got = K.fill_missing(e, methods={"value": "interpolate"}, order_by="event_id").toPandas()
    got = got.sort_values("event_id")["value"].tolist()
    for g, x in zip(got, exp):
        assert (g is None or g != g) if x != x else g == pytest.approx(x)


def test_rolling_with_small_blocks_matches_pandas(events):
    out = W.rolling(events, "value", 4, order_by=["ts", "event_id"], partition_by="user_id",
                    block_rows=7).toPandas()
    pdf = events.select("event_id", "ts", "user_id", "value").toPandas().sort_values(["user_id", "ts", "event_id"])
    pdf["exp"] = pdf.groupby("user_id")["value"].transform(lambda s: s.rolling(4).mean())
    m = out.merge(pdf[["event_id", "exp"]], on="event_id")
    for g, x in zip(m["value_rolling_mean"], m["exp"]):
        assert (g is None or g != g) if x != x else g == pytest.approx(x)


def test_running_total_small_blocks(events):
    pdf = events.select("event_id", "ts", "value").toPandas().sort_values(["ts", "event_id"])
    pdf["exp"] = pdf["value"].cumsum()
    for block in (13, 1 << 20):
        out = W.running_total(events, "value", ["ts", "event_id"], block_rows=block).toPandas()
        m = out.merge(pdf[["event_id", "exp"]], on="event_id")
        assert m["running_total"].tolist() == pytest.approx(m["exp"].tolist())


def test_ntile_matches_definition(events):
    out = W.ntile(events, "value", 7, tie_break="event_id").toPandas()
    out = out.sort_values(["value", "event_id"])
    n = len(out)
    q, r = divmod(n, 7)
    sizes = [q + 1] * r + [q] * (7 - r)
    exp = [b + 1 for b, s in enumerate(sizes) for _ in range(s)]
    assert out["ntile"].tolist() == exp


def test_running_total_nulls_in_small_blocks(spark):
    """A NULL adds nothing and shows the total so far, whatever the block size."""
    values = [None, 1.0, 2.0, None, None, 5.0, None, -1.0, None, None, 4.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(3)
    want, total = [], None
    for v in values:
        total = total if v is None else (total or 0.0) + v
        want.append(total)
    for block in (1, 2, 3, 4, 100):
        out = W.running_total(df, "v", ["i"], block_rows=block).orderBy("i")
        assert [r.running_total for r in out.collect()] == want


def test_percent_rank_equals_definition(many_files):
    """(rows below) / (rows - 1), as SQL's percent_rank; pandas' min rank gives the rows below."""
    li = many_files.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber",
                                                                      "l_returnflag", "l_quantity")
    pdf = li.toPandas()
    for pb in (None, "l_returnflag"):
        got = sorted((r.l_returnflag, r.l_quantity, round(r.percent_rank, 12))
                     for r in W.percent_rank(li, "l_quantity", pb).collect())
        values = pdf.groupby(pb)["l_quantity"] if pb else pdf["l_quantity"]
        size = values.transform("size") if pb else len(pdf)
        want = ((values.rank(method="min") - 1) / (size - 1)).round(12)
        assert got == sorted(zip(pdf.l_returnflag, pdf.l_quantity, want))


def test_group_rank(events):
    out = group_rank(events, ["user_id"], ["ts", "event_id"], name="r", size="n").toPandas()
    pdf = out.sort_values(["user_id", "ts", "event_id"])
    exp = pdf.groupby("user_id").cumcount().tolist()
    assert pdf["r"].tolist() == exp
    assert (pdf["n"] == pdf.groupby("user_id")["r"].transform("size")).all()


def test_slice_negative_step(events):
    out = S.slice_rows(events, None, None, -3, order_by="event_id", position="p").toPandas()
    ids = sorted(events.select("event_id").toPandas()["event_id"])
    assert sorted(out["event_id"]) == sorted(ids[::-3])


def test_stratified_sample_too_small_group_raises(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(10)], "k long, g string")
    with pytest.raises(Exception):
        S.sample_rows(df, n=4, by="g", key="k").collect()


def test_sample_with_replacement_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = sorted(r.k for r in S.sample_rows(df, n=30, replace=True, random_state=3, key="k").collect())
    b = sorted(r.k for r in S.sample_rows(df, n=30, replace=True, random_state=3, key="k").collect())
    assert a == b and len(a) == 30


def test_funnel_order_respected(spark):
    import datetime as dt
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, t(1), "view"), (1, t(2), "click"), (1, t(3), "purchase"),
            (2, t(5), "view"), (2, t(4), "click"),                 # click before view
            (3, t(1), "click"), (3, t(2), "view"), (3, t(3), "click")]
    df = spark.createDataFrame(rows, "u long, ts timestamp_ntz, e string")
    out = {r.step: r.users for r in W.funnel(df, "u", "ts", "e", ["view", "click", "purchase"]).collect()}
    assert out == {"view": 3, "click": 2, "purchase": 1}


def test_pos_column_constant(events):
    assert POS == "_tw_pos"
    assert isinstance(pd.__version__, str)


def test_hot_key_third_of_rows(many_files):
    """One key holds a third of all rows: ranks, running totals and rolling stay exact."""
    df = many_files.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', CAST(id % 50 AS STRING)) END AS g",
        "CAST((id * 7919) % 1000 AS DOUBLE) AS v")
    pdf = df.toPandas().sort_values(["g", "id"])
    r = group_rank(df, ["g"], ["id"], name="r", size="n").toPandas().sort_values(["g", "id"])
    assert r["r"].tolist() == pdf.groupby("g").cumcount().tolist()
    assert int(r.loc[r.g == "hot", "n"].iloc[0]) == 1000
    run = W.running_total(df, "v", ["id"], partition_by="g", block_rows=64).toPandas().sort_values(["g", "id"])
    assert run["running_total"].tolist() == pytest.approx(pdf.groupby("g")["v"].cumsum().tolist())
    roll = W.rolling(df, "v", 5, ["id"], partition_by="g", fn="sum", block_rows=64).toPandas()
    roll = roll.sort_values(["g", "id"])
    exp = pdf.groupby("g")["v"].transform(lambda s: s.rolling(5).sum()).tolist()
    got = roll["v_rolling_sum"].tolist()
    assert [None if x != x else x for x in exp] == [None if (g is None or g != g) else g for g in got]


def test_first_rows_equal_pandas(spark):
    """Largest rows, a page and a stratified sample against pandas and the md5 rule."""
    import hashlib
    from tablewright.operators import selection as Sel
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    pdf = o.select("o_orderkey", "o_totalprice", "o_orderpriority").toPandas()
    top = pdf.sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).head(40)
    got = Sel.nlargest(o, 40, "o_totalprice", tie_break="o_orderkey").collect()
    assert sorted(r.o_orderkey for r in got) == sorted(top.o_orderkey)
    third = pdf.sort_values(["o_totalprice", "o_orderkey"]).iloc[14:21]
    page = Sel.page(o, 3, 7, ["o_totalprice", "o_orderkey"]).collect()
    assert sorted(r.o_orderkey for r in page) == sorted(third.o_orderkey)
    pdf["h"] = [hashlib.md5(f"{k}|2".encode()).hexdigest() for k in pdf.o_orderkey]
    want = pdf.sort_values(["h", "o_orderkey"]).groupby("o_orderpriority").head(5)
    strat = Sel.sample_rows(o, n=5, by="o_orderpriority", key="o_orderkey", random_state=2).collect()
    assert sorted(r.o_orderkey for r in strat) == sorted(want.o_orderkey)


def test_salted_join_equals_plain_join(many_files):
    from tablewright.operators import joins as J
    left = many_files.range(6000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 40 END AS k", "id * 2 AS v")
    right = many_files.range(40).selectExpr("id AS k", "concat('n', CAST(id AS STRING)) AS name")
    plain = J.merge_tables(left, right, "left", on="k")
    salted = J.merge_tables(left, right, "left", on="k", salt=8)
    a = sorted(tuple(r) for r in plain.collect())
    b = sorted(tuple(r) for r in salted.collect())
    assert a == b and len(a) == 6000
    assert J.heavy_keys(left, ["k"], 1 / 8) == [(7,)]


def test_positions_with_total_and_file(many_files):
    """Positions of one row per value, with the total and the file number."""
    e = many_files.read.parquet(f"{SF001}/events.parquet")
    a = {r.event_id: r.p for r in with_position(e, ["value", "event_id"], name="p").collect()}
    got = with_position(e, ["value", "event_id"], name="p", total="n", keep_partition=True)
    b = {r.event_id: r.p for r in got.collect()}
    assert a == b and got.select("n").distinct().count() == 1
    f = K.fill_missing(e.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value")),
                       method="ffill", order_by="event_id").count()
    assert f == e.count()


def test_growth_paths_agree(many_files):
    """The join of each period with the one before equals pandas' percent change."""
    o = many_files.read.parquet(f"{SF001}/orders.parquet").withColumn(
        "m", F.date_trunc("month", "o_orderdate"))

    pdf = o.select("m", "o_orderpriority", "o_totalprice").toPandas()
    for by in ([], ["o_orderpriority"]):
        got = {tuple(r[c] for c in [*by, "m"]): r.growth_pct for r in W.growth_pct(
            o, "m", "o_totalprice", by=by, agg="count").collect()}
        n = pdf.groupby([*by, "m"]).size()
        pct = (n.groupby(level=by).pct_change() if by else n.pct_change()).fillna(0) * 100
        want = {k if isinstance(k, tuple) else (k,): v for k, v in pct.items()}
        assert len(got) > 10 and got == {k: pytest.approx(v) for k, v in want.items()}


def test_hash_prefix_sample_equals_full_sort(many_files):
    from tablewright.operators import selection as Sel
    o = many_files.read.parquet(f"{SF001}/orders.parquet")
    h = Sel.sample_key(["o_orderkey"], 9)
    full = [r.o_orderkey for r in o.orderBy(h, "o_orderkey").limit(1234).collect()]
    got = Sel.smallest_by_hash(o, h, ["o_orderkey"], n=1234)
    assert sorted(r.o_orderkey for r in got.collect()) == sorted(full)
    frac = Sel.sample_rows(o, frac=0.13, random_state=9, key="o_orderkey")
    exp = round(0.13 * o.count())
    assert sorted(r.o_orderkey for r in frac.collect()) == sorted(
        r.o_orderkey for r in o.orderBy(h, "o_orderkey").limit(exp).collect())


def test_drop_positions_equals_pandas(many_files):
    import tablewright.operators.cleaning as Cl
    o = many_files.read.parquet(f"{SF001}/orders.parquet")
    idx = [0, 3, 17, -1, -5]
    got = sorted(r.o_orderkey for r in Cl.drop_rows(o, indices=idx, order_by=["o_totalprice", "o_orderkey"]).collect())
    pdf = o.select("o_orderkey", "o_totalprice").toPandas().sort_values(["o_totalprice", "o_orderkey"])
    keep = [k for i, k in enumerate(pdf.o_orderkey) if i not in {x % len(pdf) for x in idx}]
    assert got == sorted(keep) and len(got) == len(pdf) - 5


def test_slice_equals_positions(many_files):
    from tablewright.operators import selection as Sel
    o = many_files.read.parquet(f"{SF001}/orders.parquet")
    a = sorted((r.o_orderkey, r.p) for r in Sel.slice_rows(o, 5, 300, 7, order_by="o_orderkey", position="p").collect())
    keys = sorted(r.o_orderkey for r in o.select("o_orderkey").collect())
    assert a == sorted(zip(keys[5:300:7], range(5, 300, 7)))
