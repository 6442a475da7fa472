"""Records of delimited text, cut in parallel (SRC-1..3).

A quoted cell may hold line breaks, so a line is the start of a record only if an
even number of quotes stands before it in the file.  That is a prefix sum over the
splits of a scan:

1. one aggregate over the lines tests every file for valid UTF-8 and looks for lines
   with an odd number of quotes.  Without any, every line is a record and that is all;
2. else the lines are kept once in the checkpoint folder, whole stretches of a split in
   a row, with the split they stand in.  What a scan calls a split depends on the
   settings and the cores of the moment it runs, so two scans may cut a file at
   different places; one kept copy is cut once;
3. one aggregate over the copy says which splits hold lines with an odd number of
   quotes; the driver, which holds one row per split, cumulates the parity;
4. each task cuts its own splits, whose parity at the start it is told.  Lines without
   an open quote pass as they are; only what is cut by the edge of a split leaves its
   task, keyed by the split the record began in.

So one huge file is read by as many tasks as it has splits, whatever its cells hold.
A file that is not valid UTF-8 is read in the next encoding of the chain, file by file.

Defined results: line breaks inside a cell come back as line feeds; empty lines
outside cells are no records; a file that ends inside a quote ends with that record; a
byte-order mark is dropped.  Quotes must be doubled inside quoted cells, and not
stand alone in others.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of the kept lines hold about so many bytes, or one line.
STRETCH = 1 << 20
#: Small splits are kept several in a task, by about so many bytes, yet in some tasks a core.
TASK_BYTES, CORE_TASKS = 32 << 20, 4

#: The chain of encodings: the first that fits a whole file holds for it; the last fits any bytes.
ENCODINGS = ("UTF-8", "ISO-8859-1")


def decoded(data: bytes, encoding: str | None = None, encodings=ENCODINGS) -> str:
    """The text of some bytes: in `encoding`, else in the first of the chain that they fit."""
    for name in [encoding] if encoding else encodings[:-1]:
        try:
            return data.decode(name).removeprefix("\ufeff")
        except UnicodeDecodeError:
            continue
    return data.decode(encoding or encodings[-1], "replace").removeprefix("\ufeff")


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(value as bytes, file, block) of every physical line."""
    raw = spark.read.text(paths)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("_line"))


def _stretched(quote: str):
    """Batches of (value, file, block) to batches of (lines, odd, file, block): the lines of a split joined
    by line feeds, some in a row, in order, and the number of those with an odd number of quotes."""
    schema = pa.schema([("lines", pa.binary()), ("odd", pa.int64()), ("file", pa.string()), ("block", pa.int64())])
    mark = quote.encode()

    def run(batches):
        for b in batches:
            size, files, blocks = pc.binary_length(b.column("value")).to_pylist(), b.column("file").to_pylist(), b.column("block").to_pylist()
            odd = pc.count_substring(b.column("value"), pattern=mark).to_numpy(zero_copy_only=False) % 2
            i = 0
            while i < b.num_rows:
                j, held = i + 1, size[i]
                while j < b.num_rows and blocks[j] == blocks[i] and files[j] == files[i] and held + size[j] < STRETCH:
                    held += size[j] + 1
                    j += 1
                joined = b"\n".join(b.column("value").slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_pylist([{"lines": joined, "odd": int(odd[i:j].sum()), "file": files[i], "block": blocks[i]}], schema)
                i = j

    return run


def splits(stretches: DataFrame) -> dict:
    """{(file, block): block in which the record open at its start began}."""
    rows = stretches.groupBy("file", "block").agg(F.sum("odd").alias("odd")).where(F.col("odd") > 0).select("file", "block", "odd")
    every = stretches.select("file", "block").distinct().join(rows, ["file", "block"], "left").collect()
    opened, state = {}, {}
    for r in sorted(every, key=lambda r: (r["file"], r["block"])):
        since = state.get(r["file"])  # the block of the record open so far
        if since is not None:
            opened[r["file"], r["block"]] = since
        odd = r["odd"] or 0
        if odd % 2:
            # an odd number of such lines closes an open record, or leaves a new one open
            state[r["file"]] = r["block"] if since is None else None
        elif since is not None and odd:
            state[r["file"]] = r["block"]  # it closed here, and another one is open at the end
    return opened


def records(spark: SparkSession, paths, quote: str = '"', encoding: str | None = None, encodings=ENCODINGS) -> DataFrame:
    """(record, first): every record's text; `first` marks the first one of its file."""
    lines = _lines(spark, paths)
    odd = (F.length("_line") - F.length(F.replace("_line", F.lit(quote), F.lit("")))) % 2
    found = lines.groupBy("file").agg(F.every(F.is_valid_utf8("_line")).alias("valid"), F.sum(odd).alias("odd"),
                                      F.sum(F.octet_length("_line")).alias("bytes")).collect()
    valid = {r["file"]: r["valid"] for r in found}
    lines, stretched, opened = lines.select("value", "file", "block"), _stretched(quote), {}
    if any(r["odd"] for r in found):
        ensure_checkpoint_dir(spark)
        tasks = max(CORE_TASKS * spark.sparkContext.defaultParallelism, sum(r["bytes"] for r in found) // TASK_BYTES)
        lines = lines.coalesce(tasks).mapInArrow(stretched, "lines binary, odd long, file string, block long").checkpoint()
        opened = splits(lines)
        stretched = iter
    coding = {f: encoding or (encodings[0] if ok else encodings[-1]) for f, ok in valid.items()}
    mark = quote.encode()
    schema = pa.schema([("file", pa.string()), ("since", pa.int64()), ("part", pa.int64()), ("record", pa.string()), ("first", pa.bool_())])

    def run(batches):
        held: list[bytes] = []
        at, odd, edge, begun = None, False, None, False  # split; inside a quote; block of a record from further left; a record seen

        def row(text, since, first):
            if first and text.startswith(b"\xef\xbb\xbf"):
                text = text[3:]
            return at[0], since, at[1], text.decode(coding[at[0]], "replace"), first

        def close():
            """What is left at a split's end goes on in the next split."""
            return [row(b"\n".join(held), at[1] if edge is None else edge, edge is None and not begun and at[1] == 0)] if odd else []

        for b in stretched(batches):
            out = []
            files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
            for i in range(b.num_rows):
                here = (files[i], blocks[i])
                if here != at:
                    if at is not None:
                        out += close()
                    at, held = here, []
                    edge = opened.get(at)
                    odd, begun = edge is not None, False
                for line in b.column("lines")[i].as_py().split(b"\n"):
                    odd_line = line.count(mark) % 2
                    if odd or odd_line:
                        held.append(line)
                        if odd_line:
                            odd = not odd
                            if not odd:  # a record ends here
                                out.append(row(b"\n".join(held), edge, edge is None and not begun and at[1] == 0))
                                held, edge, begun = [], None, True
                    elif line:
                        out.append(row(line, None, not begun and at[1] == 0))
                        begun = True
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if at is not None and (out := close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    cut = lines.mapInArrow(run, "file string, since long, part long, record string, first boolean")
    whole = cut.where(F.col("since").isNull()).select("record", "first")
    pieces = cut.where(F.col("since").isNotNull()).groupBy("file", "since").agg(
        F.sort_array(F.collect_list(F.struct("part", "record"))).alias("p"), F.max("first").alias("first"))
    return whole.unionByName(pieces.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"), "first"))
