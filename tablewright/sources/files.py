"""File sources and sinks (SRC-1..9, SNK-1..2).

All readers return lazy DataFrames; only the delimiter sniff (five lines)
and the type inference of the tolerant CSV reader (one aggregate) run a
job, because the output schema depends on them.
"""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OperatorError, col, normalize_nan
from .records import ENCODINGS, decoded, records

# Candidate delimiters, and how many leading lines are inspected.
CANDIDATE_DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES = 5
DEFAULT_DELIMITER = ","

# The words that mean a missing cell in delimited text.
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

FORMATS = {
    ".csv": "csv", ".tsv": "csv", ".txt": "csv",
    ".parquet": "parquet", ".pq": "parquet",
    ".json": "json", ".jsonl": "json", ".ndjson": "json",
    ".orc": "orc",
}


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's files and sub-folders, listed by the scan of Spark's binary-file source
    (no content is read), so any file system Spark knows will do."""
    root = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rest = F.substring_index(F.col("path"), "/" + root.split("/")[-1] + "/", -1)
    names = found.select(F.substring_index(rest, "/", 1).alias("name")).distinct().collect()
    return sorted(r["name"] for r in names)


def detect_format(path: str, spark: SparkSession | None = None) -> str:
    """Format by file suffix (a folder of part files counts by its name, else by its files')."""
    p = path.rstrip("/")
    for suffix, fmt in FORMATS.items():
        if p.lower().endswith(suffix):
            return fmt
    for n in _children(spark, p) if spark else []:
        for suffix, fmt in FORMATS.items():
            if n.lower().endswith(suffix) and not n.startswith(("_", ".")):
                return fmt
    raise OperatorError(f"Unsupported file type: {path}")


def sniff_delimiter(spark: SparkSession, path: str, encoding: str | None = None) -> str:
    """The candidate occurring most often in the first lines, default ','."""
    reader = spark.read
    if encoding:
        reader = reader.option("encoding", encoding)
    lines = [r.value for r in reader.text(path).limit(SNIFF_LINES).collect()]
    text = "\n".join(lines)
    counts = {d: text.count(d) for d in CANDIDATE_DELIMITERS}
    best = max(counts.values()) if counts else 0
    if best == 0:
        return DEFAULT_DELIMITER
    return next(d for d in CANDIDATE_DELIMITERS if counts[d] == best)


def _header(spark: SparkSession, path: str, sep: str, encoding: str | None, encodings=ENCODINGS) -> list[str]:
    if encoding and encoding.upper().startswith(("UTF-16", "UTF-32")):
        first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
        line = first[0].value if first else None
    else:
        first = spark.read.text(path).select(F.col("value").cast("binary").alias("value")).limit(1).collect()
        line = decoded(bytes(first[0].value), encoding, encodings) if first else None
    if line is None:
        raise OperatorError(f"Empty file: {path}")
    return next(csv.reader(io.StringIO(line), delimiter=sep))


def _infer_types(df: DataFrame, names: list[str]) -> DataFrame:
    """Cast text columns to long / double / boolean when every value parses.

    One aggregate computes, for every column, how many non-null values
    fail each cast; the narrowest type without failures wins.
    """
    checks = []
    for name in names:
        c = col(name)
        checks += [
            F.sum(F.when(c.isNotNull() & F.expr(f"try_cast({_q(name)} as bigint)").isNull(), 1)
                  .otherwise(0)).alias(f"{name}\x00long"),
            F.sum(F.when(c.isNotNull() & F.expr(f"try_cast({_q(name)} as double)").isNull(), 1)
                  .otherwise(0)).alias(f"{name}\x00double"),
            F.sum(F.when(c.isNotNull() & ~F.lower(F.trim(c)).isin("true", "false"), 1)
                  .otherwise(0)).alias(f"{name}\x00bool"),
            F.count(c).alias(f"{name}\x00n"),
        ]
    if not checks:
        return df
    row = df.agg(*checks).first().asDict()
    out = []
    for name in df.columns:
        c = col(name)
        if name not in names:
            out.append(c.alias(name))
        elif row[f"{name}\x00n"] == 0:
            out.append(c.alias(name))
        elif row[f"{name}\x00long"] == 0:
            out.append(F.expr(f"try_cast({_q(name)} as bigint)").alias(name))
        elif row[f"{name}\x00double"] == 0:
            out.append(F.expr(f"try_cast({_q(name)} as double)").alias(name))
        elif row[f"{name}\x00bool"] == 0:
            out.append((F.lower(F.trim(c)) == "true").alias(name))
        else:
            out.append(c.alias(name))
    return df.select(*out)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str | None = None,
             encoding: str | None = None, skip_long_rows: bool = True,
             infer_types: bool = True, header: bool | list[str] = True,
             types: dict[str, str] | None = None, encodings=ENCODINGS) -> DataFrame:
    """Delimited text with a header row (SRC-1..3).

    Rows with more fields than the header are skipped and short rows are
    padded with NULL.  Spark's own modes do neither (PERMISSIVE truncates
    long rows, DROPMALFORMED also drops short ones), so every field is read
    as text with one extra overflow column, rows that fill it are dropped,
    and types are inferred from the kept rows only.  ``header`` may also be
    the list of column names of header-less files (e.g. part files).
    ``MISSING_WORDS`` are NULL.  Several paths are one scan with one
    inference (the first one's header holds).  ``types`` names the type of
    columns that should not be inferred.

    Quoted cells may hold line breaks, and a file is still read by many
    tasks (``records``).  Without ``encoding`` each file is read in the first
    of ``encodings`` that its bytes fit.  Encodings in which a line break or a
    quote is not one byte (UTF-16) are read by Spark's own reader, a file a task.
    """
    first = path[0] if isinstance(path, list) else path
    sep = delimiter or sniff_delimiter(spark, first, encoding)
    names = list(header) if isinstance(header, (list, tuple)) else _header(spark, first, sep, encoding, encodings)
    if not names:
        raise OperatorError(f"No columns in {path}")
    width = len(names) + bool(skip_long_rows)
    text = ", ".join(f"c{i} string" for i in range(width))
    options = {"sep": sep, "mode": "PERMISSIVE", "escape": '"'}
    if encoding and encoding.upper().startswith(("UTF-16", "UTF-32")):
        df = spark.read.options(header=header is True, multiLine=True, encoding=encoding, **options).schema(text).csv(path)
    else:
        found = records(spark, path, encoding=encoding, encodings=encodings)
        if header is True:
            found = found.where(~F.col("first"))
        df = found.select(F.inline(F.array(F.from_csv("record", text, options))))
    if skip_long_rows:
        df = df.filter(F.col(f"c{width - 1}").isNull())
    df = df.select(*[F.when(~F.col(f"c{i}").isin(MISSING_WORDS), F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
    types = types or {}
    if infer_types:
        df = _infer_types(df, [c for c in names if c not in types])
    return df.withColumns({c: col(c).cast(t) for c, t in types.items()}) if types else df


def read_table(spark: SparkSession, path: str, fmt: str | None = None, nan_to_null: bool = True, **options) -> DataFrame:
    """Format dispatch by suffix (SRC-4): csv/tsv, parquet, json, orc.

    NaN becomes NULL, the one missing value of the library; ``nan_to_null=False``
    keeps it, and with it the push-down of filters on floating columns.
    """
    fmt = fmt or detect_format(path, spark)
    if fmt == "csv":
        return read_csv(spark, path, delimiter=options.pop("delimiter", None),
                        encoding=options.pop("encoding", None), **options)
    reader = spark.read.format(fmt)
    if "schema" in options:
        reader = reader.schema(options.pop("schema"))
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    return normalize_nan(df) if nan_to_null else df


def read_tables(spark: SparkSession, paths: list[str], fmt: str | None = None) -> dict[str, DataFrame]:
    """Many files, one table each, named by SRC-9's rule."""
    frames = [read_table(spark, p, fmt) for p in paths]
    stems = [os.path.splitext(os.path.basename(p.rstrip("/")))[0] for p in paths]
    return name_tables(frames, stems)


def name_tables(frames: list[DataFrame], names: list[str | None] | None = None) -> dict[str, DataFrame]:
    """SRC-9: given name, else ``current`` when there is one table, else ``table_{i}``."""
    names = names or [None] * len(frames)
    out = {}
    for i, (df, n) in enumerate(zip(frames, names)):
        key = n or ("current" if len(frames) == 1 else f"table_{i}")
        out[key] = df
    return out


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables of a folder on any file system Spark reads: files, and folders of
    part files (SRC-8)."""
    names = _children(spark, folder)
    return sorted(os.path.splitext(n)[0] for n in names if n.endswith(".parquet"))


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None,
                register: bool = False, nan_to_null: bool = True) -> dict[str, DataFrame]:
    """Catalogue of a folder of Parquet tables (SRC-8), optionally as temp views; ``nan_to_null`` as in ``read_table``."""
    there = list_tables(spark, folder)
    for n in names or []:
        if n not in there:
            raise OperatorError(f"Table '{n}' not found; available: {', '.join(there)}")
    tables = {}
    for n in names or there:
        tables[n] = read_table(spark, f"{folder.rstrip('/')}/{n}.parquet", "parquet", nan_to_null)
        if register:
            tables[n].createOrReplaceTempView(n)
    return tables


def drop_empty(df: DataFrame) -> DataFrame:
    """SRC-7: drop all-null rows, then all-null columns (one aggregate)."""
    rows = df.na.drop(how="all")
    counts = rows.agg(*[F.count(col(c)).alias(c) for c in rows.columns]).first().asDict()
    empty = [c for c, n in counts.items() if n == 0]
    return rows.drop(*empty)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", quote_all: bool = False) -> None:
    """SNK-1: header, no index; ``quote_all`` keeps white space at the ends of cells."""
    df.write.mode(mode).options(header=True, escape='"', quoteAll=quote_all, ignoreLeadingWhiteSpace=not quote_all,
                                ignoreTrailingWhiteSpace=not quote_all).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2: one JSON record per row."""
    df.write.mode(mode).json(path)


def to_json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """SNK-2 as a column: each row rendered as one JSON object."""
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias(name))


def union_files(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Same-schema files as one table: a single multi-path scan."""
    if fmt == "csv":
        return read_csv(spark, list(paths))
    return spark.read.format(fmt).load(paths)


def write_bucketed(df: DataFrame, table_name: str, keys, buckets: int, path: str | None = None,
                   mode: str = "overwrite") -> DataFrame:
    """Save a table bucketed and sorted by ``keys`` (co-located joins).

    Two tables bucketed by the same keys into the same number of buckets
    join without a shuffle of either side; ``path`` places the files in a
    shared folder (an external table), else in the session's warehouse.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = df.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table_name)
    return df.sparkSession.table(table_name)
