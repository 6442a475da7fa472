"""Streaming use of the row-wise operators.

The reference has no streams.  Row-wise operators (projection, filters,
string cleaning, replacement, constant fills, column arithmetic, date
features without the parse probe) contain no action, so the same
functions apply unchanged to a streaming DataFrame; global-statistics and
ordered operators refuse streaming input (``require_batch``).  These
helpers read a folder of Parquet files as a stream and run a list of
row-wise steps over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.steps import REGISTRY
from ..schema import OperatorError

# Operators that are safe on unbounded input (no global statistics, no order).
ROWWISE_OPERATORS = [
    "select_columns", "rename_columns", "reorder_columns", "filter_rows", "drop_rows",
    "replace_values", "clean_strings", "apply_custom", "create_interaction",
]


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in folder ``path`` as a stream (schema required).

    A single file is read as the stream of its folder filtered to that name.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rpartition("/")[2]):  # a file, not a folder
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def apply_rowwise(stream: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply row-wise steps ``{"op": name, "args": {...}}`` to a stream."""
    out = stream
    for i, s in enumerate(steps):
        if s["op"] not in ROWWISE_OPERATORS:
            raise OperatorError(f"step {i}: '{s['op']}' is not a row-wise operator")
        out = REGISTRY[s["op"]](out, **s.get("args", {}))
    return out


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream once over all available input into Parquet files, and read them."""
    q = (stream.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
