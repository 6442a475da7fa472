"""Shared column expressions and scratch handling of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import string
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The white space of every contract: space, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[ \t-\r]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder of the session."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def strip_white(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """The maximal runs of non-white characters, in order (null or blank: none)."""
    core = strip_white(F.coalesce(text, F.lit("")))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WHITE_RE))


def hold(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """Select `keep` and `columns`, each computed once a row.

    The optimizer copies a projected expression into later filters and into the
    lambdas of higher-order functions, where it would run once an element.  A
    generator of one row is not copied, so what follows reads a finished value.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def carried(df: DataFrame, columns: list[str]) -> tuple[list[Column], list[str], list[Column]]:
    """Carry `columns` under names that clash with nothing: (to select, names, to name back).

    They stay flat: fields of a struct are lost by the optimizer below several generators."""
    names = [f"_c{i}" for i in range(len(columns))]
    return [df[c].alias(n) for c, n in zip(columns, names, strict=True)], names, [
        F.col(n).alias(c) for c, n in zip(columns, names, strict=True)]


def literal_doubles(values: list[float]) -> Column:
    """A constant array<double>; the optimizer folds it into one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def whole_groups(batches, names: list[str], rows: int = 8192):
    """Tables of whole groups from record batches sorted by the columns `names`.

    Each table has `rows` rows or more but for the last; memory holds one table,
    one group and one batch.  Yields (table, group number of each row)."""
    held, count = [], 0

    def grouped():
        table = pa.Table.from_batches(held)
        cols = [table.column(c).to_numpy() for c in names]
        return table, np.r_[0, np.any([c[1:] != c[:-1] for c in cols], axis=0).cumsum()]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= rows:
            table, group = grouped()
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if last:
                yield table.slice(0, last), group[:last]
                held = table.slice(last).combine_chunks().to_batches()
                count = table.num_rows - last
    if held:
        yield grouped()


def sliced(batches, weights, most: int):
    """The batches' rows in slices of about `most` by `weights(batch)` (one number a row), so that
    what a task makes of a slice stays small whatever a batch holds."""
    for b in batches:
        ends = np.cumsum(np.maximum(weights(b), 1)) if b.num_rows else np.empty(0)
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, upto - at)
            at = upto


def text_bytes(name: str):
    """weights for `sliced`: the UTF-8 bytes of a string column."""
    return lambda b: pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.names.index(name))), 0).to_numpy(zero_copy_only=False)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once a session, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="tablewright-")  # the driver serves it from here
        _SHIPPED[app] = shutil.make_archive(f"{folder}/tablewright", "zip", os.path.dirname(package), "tablewright")
        spark.sparkContext.addPyFile(_SHIPPED[app])
