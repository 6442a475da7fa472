"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

Long lines become (hash, document, place) rows, range-partitioned by hash and
document, so that a line found in a third of all documents is spread over many
partitions, and sorted in them by hash, document and place.  Numbering the rows of
each (hash, document) run in that order streams the run's first occurrence out of
the sorted partition; one row a document is left.  Partial aggregation makes of
these the per-hash facts (documents, keeper), and what is dropped comes back as a
bitmap of 64 lines a word, of which only words with a dropped line are stored.
Texts never move until a bitmap is applied.

Defined results: null or empty text is one empty line; rows that share a doc_id
count as one document, and each loses the same places' lines by its own text;
rows without doc_id take no part and keep every line; an empty table gives an
empty result.  Lines are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, carried, cut, hold, strip_white


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, place, h1, h2) of every line whose key has `min_chars` code points.

    `row` is a hash of the text, which tells rows under one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    # the line's own length bounds its key's: most short lines go before the key is made
    lines = lines.where(F.length("line") >= min_chars)
    lines = hold(lines, ["doc_id", "row", "place"], key=ascii_lower(strip_white(F.col("line"))))
    return lines.where(F.length("key") >= min_chars).select(
        "doc_id", "row", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def repeated_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper) of lines found in at least `min_docs` documents."""
    run = ["h1", "h2", "doc_id"]
    spread = rows.select(*run, "place").repartitionByRange(*run)
    # the range partitions hold whole runs, so the window needs their sort but no other exchange
    nth = F.row_number().over(Window.partitionBy(*run).orderBy("place"))
    first = spread.withColumn("nth", nth).where(F.col("nth") == 1)
    facts = first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return facts.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, keep): keep maps place // 64 to 64 keep bits; a missing word keeps all.

    Lines found in `min_docs` documents stay in the largest doc_id only."""
    rows = cut(line_rows(docs, min_chars))
    # cut, so that the join meets two plain shuffles: a line's rows can then be split over tasks
    hits = rows.join(cut(repeated_lines(rows, min_docs)), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = hits.groupBy("doc_id", "row", F.expr("place div 64").cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(one)).alias("bits"))
    return words.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, prefix: str = "") -> DataFrame:
    """Add n_lines, n_dropped and kept_text (with `prefix`) to the documents."""
    names = [prefix + x for x in ("n_lines", "n_dropped", "kept_text")]
    first, rest, back = carried(docs, [c for c in docs.columns if c not in names])
    text = F.coalesce(docs["text"], F.lit(""))
    a = docs.select(*first, text.alias("_text"), docs["doc_id"].alias("_id"), F.xxhash64(text).alias("_hash"))
    b = bitmaps.select(F.col("doc_id").alias("_b_id"), F.col("row").alias("_b_row"), F.col("keep").alias("_keep"))
    # texts are the large side: they are streamed past a hash map of the bitmaps, never sorted
    a = a.join(b.hint("shuffle_hash"), (F.col("_id") == F.col("_b_id")) & (F.col("_hash") == F.col("_b_row")), "left")
    a = hold(a, [*rest, "_keep"], _lines=F.split("_text", "\n"))

    def block(w):
        part, bits = F.slice("_lines", w * 64 + 1, 64), F.element_at("_keep", w)
        return F.filter(part, lambda x, i: F.call_function("getbit", bits, i) == 1)

    n = F.size("_lines")
    blocks = F.transform(F.sequence(F.lit(0), F.expr("cast((size(_lines) - 1) div 64 as int)")), lambda w: F.when(
        F.element_at("_keep", w).isNull(), F.slice("_lines", w * 64 + 1, 64)).otherwise(block(w)))
    a = hold(a, rest, _n=n.cast("long"), _kept=F.when(F.col("_keep").isNull(), F.col("_lines")).otherwise(F.flatten(blocks)))
    return a.select(*back, F.col("_n").alias(names[0]),
                    (F.col("_n") - F.size("_kept")).cast("long").alias(names[1]),
                    F.array_join("_kept", "\n").alias(names[2]))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
