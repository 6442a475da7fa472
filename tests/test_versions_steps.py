"""Snapshots, lineage, multi-step plans and streaming end to end (written under tmp)."""

import time

import pytest

from pyspark.sql import functions as F

from tablewright.plans.steps import run_steps
from tablewright.schema import OperatorError
from tablewright.plans.versions import SnapshotStore, prune_edges, prune_plan

from conftest import SF0001


def test_snapshot_lifecycle(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    o = spark.read.parquet(f"{SF0001}/orders.parquet")
    v0 = store.save_version({"orders": o}, operation="load")
    time.sleep(0.01)
    v1 = store.save_version({"orders": o.filter("o_orderstatus = 'F'")}, operation="filter F")
    time.sleep(0.01)
    v2 = store.save_version({"orders": o.filter("o_orderstatus = 'O'")}, operation="filter O")
    assert (v0, v1, v2) == ("v0", "v1", "v2")
    assert store.load_version("v1")["orders"].count() == o.filter("o_orderstatus = 'F'").count()
    edges = {(r.parent, r.child) for r in store.edges().collect()}
    assert edges == {("v0", "v1"), ("v1", "v2")}
    assert [r.version for r in store.search("FILTER").collect()] == ["v2", "v1"]
    undo = store.undo()["orders"]
    assert undo.count() == o.filter("o_orderstatus = 'F'").count()
    b = store.create_branch("v0", "v0-b")
    assert store.load_version(b)["orders"].count() == o.count()
    kept = prune_plan(store.versions(), 2)
    assert {r.version for r in kept.filter("kept").collect()} == {"v2", "v0-b"}
    assert prune_edges(store.edges(), kept).count() == 0
    gone = store.prune(2)
    assert sorted(gone) == ["v0", "v1"]
    assert {r.version for r in store.versions().collect()} == {"v2", "v0-b"}
    store.delete_version("v2")
    assert {r.version for r in store.versions().collect()} == {"v0-b"}
    # a deleted name can be saved again, a live one cannot be written over
    store.save_version({"orders": o.limit(3)}, version="v2")
    assert store.load_version("v2")["orders"].count() == 3
    with pytest.raises(OperatorError):
        store.save_version({"orders": o}, version="v2")


def test_snapshots_through_a_uri_and_a_fresh_store(spark, tmp_path):
    root = f"file:{tmp_path}/shared"
    o = spark.read.parquet(f"{SF0001}/orders.parquet")
    assert SnapshotStore(spark, root).save_version({"t": o}) == "v0"
    assert SnapshotStore(spark, root).save_version({"t": o.limit(5)}) == "v1"
    store = SnapshotStore(spark, root)
    assert store.load_version("v0")["t"].count() == o.count() and store.load_version("v1")["t"].count() == 5
    assert store.undo()["t"].count() == o.count()


def test_steps_are_lazy_and_chained(spark):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    env = run_steps({"current": li}, [
        {"op": "filter_rows", "args": {"condition": "l_quantity > 10"}},
        {"op": "group_by_agg", "args": {"by": "l_returnflag", "agg": {"l_quantity": "sum"}}, "output": "g"},
        {"op": "nlargest", "input": "g", "args": {"n": 1, "column": "l_quantity"}, "output": "top"},
    ])
    exp = (li.filter("l_quantity > 10").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))
           .orderBy(F.desc("q")).first())
    assert env["top"].first().l_quantity == exp.q


def test_stream_into_files(spark, tmp_path):
    from tablewright.streaming.rowwise import apply_rowwise, read_stream, run_to_files
    e = spark.read.parquet(f"{SF0001}/events.parquet")
    s = read_stream(spark, f"{SF0001}/events.parquet", e.schema)
    out = apply_rowwise(s, [{"op": "filter_rows", "args": {"condition": "value > 100"}}])
    got = run_to_files(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert got.count() == e.filter("value > 100").count()
