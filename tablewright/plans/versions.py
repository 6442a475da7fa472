"""Versioned table snapshots (VER-1..9), re-aimed from an in-memory store.

A version is one Parquet folder per table under ``{root}/{version}/``; the
lineage is a small append-only Parquet table ``{root}/_lineage`` with one
row per event (save, branch, delete), numbered in sequence.  The current state
of the graph is a query over that log, so history is never rewritten, and every
save has a folder of its own.  All access goes through Spark, so the root may be
on any file system that Spark reads.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import OperatorError

LINEAGE_SCHEMA = ("version string, parent string, operation string, query string, "
                  "tables string, event string, ts timestamp_ntz, seq long, home string")


class SnapshotStore:
    """Parquet snapshots plus a lineage log under one (shared) root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths
    def _lineage_path(self) -> str:
        return f"{self.root}/_lineage"

    def _table_path(self, home: str, table: str) -> str:
        return f"{self.root}/{home}/{table}"

    def _next(self) -> int:
        return (self.log().agg(F.max("seq")).first()[0] or 0) + 1

    def _append(self, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, LINEAGE_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(self._lineage_path())

    # -- log
    def log(self) -> DataFrame:
        """Every lineage event (VER-8's operation log)."""
        try:
            return self.spark.read.schema(LINEAGE_SCHEMA).parquet(self._lineage_path())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LINEAGE_SCHEMA)

    def versions(self) -> DataFrame:
        """VER-3: live versions: those whose last event is a save or a branch."""
        names = ["parent", "operation", "query", "tables", "ts", "event", "seq", "home"]
        last = self.log().groupBy("version").agg(F.max_by(F.struct(*names), "seq").alias("e"))
        return last.filter(F.col("e.event") != "delete").select("version", "e.*")

    def edges(self) -> DataFrame:
        """VER-3: (parent, child) edges between live versions."""
        v = self.versions()
        ids = v.select(F.col("version").alias("parent"))
        return v.filter(F.col("parent").isNotNull()).select("parent", F.col("version").alias("child")) \
            .join(ids, "parent", "left_semi")

    def current(self) -> str | None:
        row = self.versions().orderBy(F.col("seq").desc()).limit(1).collect()
        return row[0]["version"] if row else None

    # -- actions
    def save_version(self, tables: dict[str, DataFrame], version: str | None = None,
                     parent: str | None = None, operation: str = "", query: str = "") -> str:
        """VER-1: write every table, then log the version (first one is ``v0``)."""
        if not tables:
            raise OperatorError("nothing to save")
        if version is None:
            known = {r["version"] for r in self.log().select("version").distinct().collect()}
            n = self.log().filter(F.col("event") == "save").count()
            while f"v{n}" in known:
                n += 1
            version = f"v{n}"
        elif self.versions().filter(F.col("version") == version).count():
            raise OperatorError(f"version '{version}' is already saved; delete it first")
        if parent is None:
            parent = self.current()
        seq = self._next()
        home = f"{version}-{seq}"  # a folder of its own: nothing is written over
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(self._table_path(home, name))
        self._append([(version, parent, operation, query, ",".join(sorted(tables)), "save",
                       _dt.datetime.now(), seq, home)])
        return version

    def load_version(self, version: str) -> dict[str, DataFrame]:
        """VER-2: the tables of a version (lazy Parquet scans)."""
        rows = self.versions().filter(F.col("version") == version).collect()
        if not rows:
            raise OperatorError(f"Unknown version '{version}'")
        src = rows[0]
        names = (src["tables"] or "").split(",")
        return {n: self.spark.read.parquet(self._table_path(src["home"], n)) for n in names if n}

    def create_branch(self, source: str, name: str | None = None) -> str:
        """VER-4: a new version pointing at an older one's data (no copy)."""
        rows = self.versions().filter(F.col("version") == source).collect()
        if not rows:
            raise OperatorError(f"Unknown version '{source}'")
        name = name or f"{source}-branch"
        if self.versions().filter(F.col("version") == name).count():
            raise OperatorError(f"version '{name}' is already there")
        self._append([(name, source, f"branch of {source}", "", rows[0]["tables"], "branch",
                       _dt.datetime.now(), self._next(), rows[0]["home"])])
        return name

    def delete_version(self, version: str) -> None:
        """VER-6: remove a version and its edges from the graph."""
        self._append([(version, None, "delete", "", "", "delete", _dt.datetime.now(), self._next(), None)])

    def prune(self, keep: int) -> list[str]:
        """VER-5: keep the newest ``keep`` versions; returns the removed ids."""
        ranked = prune_plan(self.versions(), keep)
        gone = [r["version"] for r in ranked.filter(~F.col("kept")).collect()]
        if gone:
            now = _dt.datetime.now()
            seq = self._next()
            self._append([(v, None, "prune", "", "", "delete", now, seq + i, None) for i, v in enumerate(gone)])
        return gone

    def search(self, text: str, n: int = 10) -> DataFrame:
        """VER-7: versions whose operation mentions ``text``, newest n."""
        return search_lineage(self.versions(), text, n)

    def undo(self) -> dict[str, DataFrame]:
        """VER-8: the parent snapshot of the current version."""
        cur = self.current()
        rows = self.versions().filter(F.col("version") == cur).collect()
        if not rows or rows[0]["parent"] is None:
            raise OperatorError("nothing to undo")
        return self.load_version(rows[0]["parent"])


def _newest(versions: DataFrame) -> list:
    if "seq" in versions.columns:
        return [F.col("seq").desc()]
    return [F.col("ts").desc(), F.col("version").desc()]


def prune_plan(versions: DataFrame, keep: int) -> DataFrame:
    """Mark the newest ``keep`` versions (by sequence, else time and id) as kept.

    The lineage table has one row per version, small by construction.
    """
    w = Window.orderBy(*_newest(versions))
    return versions.withColumn("_tw_rn", F.row_number().over(w)).withColumn(
        "kept", F.col("_tw_rn") <= keep).drop("_tw_rn")


def prune_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose both ends survive a prune."""
    k = kept.filter("kept").select("version")
    return (edges.join(k.withColumnRenamed("version", "parent"), "parent", "left_semi")
            .join(k.withColumnRenamed("version", "child"), "child", "left_semi"))


def search_lineage(versions: DataFrame, text: str, n: int = 10) -> DataFrame:
    return (versions.filter(F.instr(F.lower(F.col("operation")), text.lower()) > 0)
            .orderBy(*_newest(versions)).limit(n))
