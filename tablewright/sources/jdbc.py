"""Database import (SRC-6): every base table of a schema, by name.

The table list comes from ``information_schema.tables`` through the JDBC
reader; each table is then read with Spark's partitioned JDBC scan when a
numeric split column is given, so a large table is read by many tasks.
Tables that fail to load are skipped, as in the reference importer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_jdbc_tables(spark: SparkSession, url: str, schema: str = "public",
                     properties: dict | None = None) -> list[str]:
    query = ("(SELECT table_name FROM information_schema.tables "
             f"WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE') AS t")
    names = spark.read.jdbc(url, query, properties=properties or {})
    return sorted(r[0] for r in names.collect())


def load_jdbc_tables(spark: SparkSession, url: str, schema: str = "public",
                     properties: dict | None = None, split_columns: dict | None = None,
                     num_partitions: int = 64) -> dict[str, DataFrame]:
    """``split_columns``: {table: (column, lower, upper)} for partitioned reads."""
    out: dict[str, DataFrame] = {}
    split_columns = split_columns or {}
    for name in list_jdbc_tables(spark, url, schema, properties):
        full = f"{schema}.{name}"
        try:
            if name in split_columns:
                c, lo, hi = split_columns[name]
                df = spark.read.jdbc(url, full, column=c, lowerBound=lo, upperBound=hi,
                                     numPartitions=num_partitions, properties=properties or {})
            else:
                df = spark.read.jdbc(url, full, properties=properties or {})
            df.schema  # resolve now so a broken table is skipped here
            out[name] = df
        except Exception:  # noqa: BLE001 - skip tables that cannot be read
            continue
    return out
