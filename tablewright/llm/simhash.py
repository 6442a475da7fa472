"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their
bit counts is an embedding whose Manhattan distance is never above the Hamming
distance.  The segments form `groups` runs; two vectors at Manhattan distance d
or less agree in at least groups - d runs, so the cells of the projected grids
(every choice of groups - d runs) hold every pair within range in one cell.
Inside a cell pairs are tested by Manhattan distance, then exactly, and only a
spanning forest of the links leaves the task.  Equal fingerprints are one node.
Cells above `cell_rows` nodes are cut into pairs of blocks, so a task holds at
most two blocks whatever the cell's size, and no pair is lost.

Defined results: null or blank text has no words, fingerprint zero, and links
like any other; rows without doc_id take no part; repeated rows are the same
document.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_groups

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A bit is 1 if set in over half the shingles' XXH64 (seed 42); none: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), ">u8").astype("<u8")
    for at in range(0, n, 1 << 16):  # bounded memory for a huge text
        part = hashes[at: at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """(doc_id, fp), or another `key` of type `kind`: fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast(kind), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"{key} {kind}, fp long")


def copies(docs: DataFrame, shingle: int = 4, distance: int = 4, cell_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Rows of documents that may share a doc_id: those to remove so that one document, that of the
    smallest doc_id, stays of each group of near duplicates, and those to keep that occur more than
    once; both (doc_id, row) where `row` is a hash of the text.  Here a group links fingerprints,
    so that two texts under one doc_id belong to groups of their own."""
    marked = docs.where(F.col("doc_id").isNotNull()).select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")).alias("_id"), "text")
    rows = cut(fingerprints(marked, shingle, "_id", "struct<doc_id:long,row:long>").groupBy("_id").agg(
        F.first("fp").alias("fp"), F.count("*").alias("n")))
    nodes = cut(rows.groupBy("fp").agg(F.min("_id").alias("least")).withColumn("first", F.col("fp")))
    found = components(links(nodes.select("fp", "first"), distance, cell_rows=cell_rows), nodes)
    named = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    keepers = named.groupBy("component").agg(F.min("least").alias("keeper"))
    out = cut(rows.join(named.join(keepers, "component").select("fp", "keeper"), "fp"))
    return (out.where(F.col("_id") != F.col("keeper")).select("_id.*"),
            out.where((F.col("_id") == F.col("keeper")) & (F.col("n") > 1)).select("_id.*"))


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each written as a row of ones (0, 1, 3).

    In this form the Manhattan distance of two count vectors is the number of
    differing bits, and equal counts are equal bits."""
    odd = np.uint64(0x5555555555555555)
    next_bit = fp >> np.uint64(1)
    return ((fp | next_bit) & odd) | (((fp & next_bit) & odd) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distances of embedded fingerprints; never above their Hamming distance."""
    return np.bitwise_count(a ^ b)


def _masks(groups: int, distance: int) -> list[int]:
    """One mask of embedded segments for each choice of groups - distance runs."""
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    runs = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(runs, groups - distance)]


def _large_cell(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of a cell's links: breadth first over what is not yet reached,
    so that a dense cell costs little more than its rows."""
    left, vec, out, queue = fp, embed(fp), [], []
    while len(left):
        if not queue:
            queue, left, vec = [left[0]], left[1:], vec[1:]
        x = queue.pop()
        near = np.nonzero(manhattan(vec, embed(x)) <= distance)[0]
        near = near[np.bitwise_count(left[near] ^ x) <= distance]
        if len(near):
            out += [(int(x), int(y)) for y in left[near]]
            queue += list(left[near])
            stay = np.ones(len(left), bool)
            stay[near] = False
            left, vec = left[stay], vec[stay]
    return out


def _cells(key: np.ndarray, fp: np.ndarray, distance: int, large: int = 64) -> np.ndarray:
    """Links (n, 2) of whole cells: rows are sorted by `key`, a number for each cell."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    out = []
    for s, n in zip(starts[sizes > large].tolist(), sizes[sizes > large].tolist(), strict=True):
        out += _large_cell(fp[s:s + n], distance)
    found = [np.array(out, np.uint64).reshape(-1, 2)]
    here = np.flatnonzero(np.repeat(sizes <= large, sizes))
    vec = embed(fp)
    for step in range(1, large):  # each row with the one `step` below it in its cell
        here = here[here + step < len(key)]
        here = here[key[here] == key[here + step]]
        if not len(here):
            break
        at = here[manhattan(vec[here], vec[here + step]) <= distance]
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        found.append(np.stack([fp[at], fp[at + step]], axis=1))
    return _forest(np.unique(np.sort(np.concatenate(found), axis=1), axis=0))


def _forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of the links."""
    ids, ends = np.unique(pairs, return_inverse=True)
    parent, keep = list(range(len(ids))), []
    for n, (a, b) in enumerate(ends.reshape(-1, 2).tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            keep.append(n)
    return pairs[keep]


def links(nodes: DataFrame, distance: int = 4, groups: int | None = None, cell_rows: int = 4096) -> DataFrame:
    """(a, b): fingerprint links whose components are those of all pairs within `distance`.

    `nodes` has distinct longs in column fp."""
    groups = groups or distance + 2
    masks = _masks(groups, distance)

    def cells(batches):
        for b in batches:
            vec = embed(b.column(0).to_numpy().view(np.uint64))
            for k, m in enumerate(masks):
                key = (vec & np.uint64(m)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), k, np.int32)), pa.array(key), b.column(0)], ["k", "cell", "fp"])

    rows = nodes.select("fp").mapInArrow(cells, "k int, cell long, fp long")
    sizes = rows.groupBy("k", "cell").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["k", "cell"])
    # blocks of a large cell: a row goes to every pair of blocks that its own is part of
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.select("k", "cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("fp", "k", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(batches):
        for table, group in whole_groups(batches, ["k", "cell", "i", "j"]):
            ab = _cells(group, table.column("fp").to_numpy().view(np.uint64), distance).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    # nothing but a cell's rows meets in one task, and a task holds one cell and one batch
    rows = rows.repartition("k", "cell", "i", "j").sortWithinPartitions("k", "cell", "i", "j", "fp")
    return rows.mapInArrow(verify, "a long, b long")


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(fp, component): smallest label of each connected fingerprint that has a link.

    Large-star and small-star rounds: each turns the edges into stars around
    smaller nodes, their number does not grow, and the rounds needed grow with
    the logarithm of the longest chain.  `labels` has (fp, first)."""
    first = labels.select("fp", "first")
    e = edges.join(first.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b").select("u", "v").where("u != v").distinct()
    e = cut(e)
    last = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: neighbours above a node go to its smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.distinct()
        # small-star: a node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u != v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return first.join(e.select(F.col("u").alias("first"), F.col("v").alias("component")), "first").select("fp", "component")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, cell_rows: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes, distance, cell_rows=cell_rows), nodes)
    names = nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")
