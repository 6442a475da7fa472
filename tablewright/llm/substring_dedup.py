"""Substring dedup with prefix-partitioned suffix trees.

Only suffixes that start at an anchor are kept: of the `prefix`-word runs in
each window of `window` words, the one of the smallest hash.  Equal windows have
the same anchor at the same place, so every repeat of `window` words has an
anchored suffix in each of its documents, at about 2 of `window - prefix` words.

The first `prefix` words part the suffixes into groups; a group in which only
one document occurs holds no repeat and is dropped before any text moves.  The
rest carry their words (up to `window` right, and the few to the left that a
window around the anchor can have).  A group's subtree is held as its sorted
suffixes and the longest common prefixes of neighbours; an internal node of
depth d is a run with d or more common words.  The repeat of a node is extended
to the left by the tree of the reversed left words, and a window is removed
where the node pair holds a smaller doc_id.  In a group above `group_rows` equal
surroundings of the anchor are first made one suffix, with map-side combination;
if more than `group_rows` different ones are left, they get the longest prefix,
the whole window, whose nodes are keys of a plain aggregate.  So no group
outgrows a task, whether its members are alike or not.

Documents of equal word sequences are one: all but the smallest doc_id are
covered by windows that start in it.  Defined results: null or blank text has no
words and loses none; rows that share a doc_id never remove from each other;
rows without doc_id take no part and keep all words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_groups

#: Odd multipliers of the rolling hashes of 2, 4, 8 and 16 words (any would do).
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHash(dict):
    """Hashes of words, kept up to a bounded number."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _WordHash()


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """`pick` (np.minimum or np.maximum) over each run of `size` numbers."""
    width = 1
    while 2 * width <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:len(x) - (size - width)], x[size - width:]) if size > width else x


def run_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words (a power of two)."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width, step = 1, 0
    while width < size:
        h = h[:-width] * _MULT[step % len(_MULT)] + h[width:]
        width, step = 2 * width, step + 1
    h = (h ^ (h >> np.uint64(32))) * _MULT[0]
    return h ^ (h >> np.uint64(29))


def anchors(words: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs that are the smallest of some window, ties included."""
    if len(words) < window:
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    h = run_hashes(words, prefix)
    span = window - prefix + 1
    low = _slide(h, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((edge, low, edge)), span, np.maximum) == h)
    return at.astype(np.int32), h[at]


def _lists(counts: list[int], values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def scan(docs: DataFrame, window: int = 50, prefix: int = 16) -> DataFrame:
    """(doc_id, row, n_words, sha, places, hashes): one pass over the texts.

    `row` is a hash of the text; sha is that of the words joined by one space."""

    def run(batches):
        for b in batches:
            n, sha, at, hashes = [], [], [], []
            for t in b.column(2):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                x, h = anchors(words, window, prefix)
                at.append(x)
                hashes.append(h)
            counts = [len(x) for x in at]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha),
                _lists(counts, np.concatenate(at), pa.int32()), _lists(counts, np.concatenate(hashes).view(np.int64), pa.int64()),
            ], ["doc_id", "row", "n_words", "sha", "places", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row long, n_words long, sha string, places array<int>, hashes array<long>")


def _digest(data: bytes) -> list[int]:
    return np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist()


def _contexts(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """Suffix rows of the texts' chosen anchors: hash, large, doc_id, row, place, and the words
    around the anchor (`left` before it, `right` from it on) with their digest c1, c2."""
    reach = window - prefix
    names = ("hash", "large", "c1", "c2", "doc_id", "row", "place", "left", "right", "words")

    def run(batches):
        out = []
        for b in batches:
            for r in b.to_pylist():
                words = r["text"].encode("utf-8", "surrogatepass").split()
                for p in r["at"]:
                    at, left = p["place"], min(reach, p["place"])
                    part = words[at - left:at + window]
                    text = b" ".join(part)
                    c = _digest(b"%d %s" % (left, text)) if p["large"] else (0, 0)
                    out.append((p["hash"], p["large"], *c, r["doc_id"], r["row"], at, left, len(part) - left, text))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), schema)

    schema = pa.schema([("hash", pa.int64()), ("large", pa.bool_()), ("c1", pa.int64()), ("c2", pa.int64()), ("doc_id", pa.int64()),
                        ("row", pa.int64()), ("place", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("words", pa.binary())])
    return rows.mapInArrow(run, "hash long, large boolean, c1 long, c2 long, doc_id long, row long, place int, left int, right int, words binary")


def _windows(contexts: DataFrame, window: int) -> DataFrame:
    """Every window around the anchor of each context: its digest w1, w2, and how far left it starts."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("w1", "w2", "c1", "c2", "least", "o")}
            for r in b.to_pylist():
                words = r["words"].split(b" ")
                for s in range(min(r["left"], len(words) - window) + 1):
                    for c, v in zip(out.values(), (*_digest(b" ".join(words[s:s + window])), r["c1"], r["c2"], r["least"], r["left"] - s), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.int32() if k == "o" else pa.int64()) for k in out]))

    return contexts.select("c1", "c2", "least", "left", "words").mapInArrow(run, "w1 long, w2 long, c1 long, c2 long, least long, o int")


def _tree(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of a matrix of word codes: (order, common words with the one before)."""
    big = np.ascontiguousarray(codes.astype(">u4"))
    order = np.argsort(big.view(f"V{4 * codes.shape[1]}").ravel(), kind="stable")
    sorted_ = codes[order]
    differ = sorted_[1:] != sorted_[:-1]
    return order, np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])]


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node of string depth `depth` above each suffix."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth) if depth else 0
    return out


def repeats_in(doc: np.ndarray, left: np.ndarray, words: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): how far left of the anchor removed windows start, -1 if none.

    A window that starts o words left of the anchor is removed if a suffix of a
    smaller doc_id shares it: same node at depth window - o of the tree of right
    words, and same node at depth o of the tree of reversed left words."""
    n, reach = len(doc), window - prefix
    code: dict[bytes, int] = {}
    pad = np.arange(n, dtype=np.int64)[:, None] + (1 << 31)  # a missing word equals no other
    right, before = np.repeat(pad, window, axis=1), np.repeat(pad, max(reach, 1), axis=1)
    for i, w in enumerate(words):
        c = [code.setdefault(x, len(code)) for x in w.split(b" ")]
        k = left[i]
        right[i, :len(c) - k] = c[k:]
        before[i, :k] = c[:k][::-1]
    r, b = _tree(right), _tree(before)
    first, last = np.full(n, -1), np.full(n, -1)
    for o in range(reach + 1):
        key = _nodes(*r, window - o) * (n + 1) + _nodes(*b, o)
        _, node = np.unique(key, return_inverse=True)
        low = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, node, doc)
        hit = doc > low[node]
        last[hit] = o
        first[hit & (first < 0)] = o
    return first, last


def _in_trees(suffixes: DataFrame, ids: list[str], window: int, prefix: int) -> DataFrame:
    """`ids` (longs) and (first, last) of `repeats_in`, from whole prefix groups: suffixes have
    hash, doc_id, left, words."""

    def run(batches):
        for table, _ in whole_groups(batches, ["hash"]):
            doc = table.column("doc_id").to_numpy()
            first, last = repeats_in(doc, table.column("left").to_numpy(), table.column("words").to_pylist(), window, prefix)
            hit = np.flatnonzero(last >= 0)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(table.column(c).to_numpy()[hit], pa.int64()) for c in ids], pa.array(first[hit].astype(np.int32)),
                 pa.array(last[hit].astype(np.int32))], [*ids, "first", "last"])

    suffixes = suffixes.repartition("hash").sortWithinPartitions("hash")
    suffixes = suffixes.select("hash", "doc_id", "left", "words", *[c for c in ids if c != "doc_id"])
    return suffixes.mapInArrow(run, ", ".join(f"{c} long" for c in ids) + ", first int, last int")


def repeated_spans(docs: DataFrame, scanned: DataFrame, window: int = 50, prefix: int = 16, group_rows: int = 500) -> DataFrame:
    """(doc_id, row, spans): word spans of `docs` covered by windows that also start in a
    smaller doc_id, for the smallest document of each word sequence.  `scanned` is `scan`'s."""
    usable = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    own = usable.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    rows = usable.join(own, ["sha", "doc_id"]).select("doc_id", "row", F.explode(F.arrays_zip("places", "hashes")).alias("x"))
    rows = rows.select("doc_id", "row", F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"))
    groups = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    groups = groups.where("a < b").select("hash", (F.col("n") > group_rows).alias("large"))
    chosen = rows.join(groups, "hash").groupBy("doc_id", "row").agg(F.collect_list(F.struct("place", "hash", "large")).alias("at"))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    found = cut(_contexts(texts.join(chosen.hint("shuffle_hash"), ["doc_id", "row"]), window, prefix))
    small = _in_trees(found.where("not large"), ["doc_id", "row", "place"], window, prefix).select(
        "doc_id", "row", (F.col("place") - F.col("last")).cast("int").alias("start"),
        (F.col("place") - F.col("first") + window).cast("int").alias("end"))
    # large groups: equal surroundings are one suffix, that of their smallest document
    many = found.where("large")
    contexts = cut(many.groupBy("hash", "c1", "c2").agg(
        F.min("doc_id").alias("least"), F.first("left").alias("left"), F.first("words").alias("words")))
    sizes = contexts.groupBy("hash").agg((F.count("*") > group_rows).alias("deep"))
    contexts = contexts.join(sizes, "hash")
    trees = _in_trees(contexts.where("not deep").withColumn("doc_id", F.col("least")), ["c1", "c2"], window, prefix)
    nodes = _windows(contexts.where("deep"), window)
    lowest = nodes.groupBy("w1", "w2").agg(F.min("least").alias("lowest"))
    deep = nodes.join(lowest, ["w1", "w2"]).where("least > lowest").groupBy("c1", "c2").agg(
        F.min("o").alias("first"), F.max("o").alias("last"))
    # a later document of equal surroundings loses them whole, the first what its nodes say
    hits = many.drop("words").join(contexts.select("c1", "c2", "least"), ["c1", "c2"]).join(trees.union(deep), ["c1", "c2"], "left")
    copy = F.col("doc_id") > F.col("least")
    large = hits.where(copy | F.col("last").isNotNull()).select(
        "doc_id", "row", F.when(copy, F.col("place") - F.col("left")).otherwise(F.col("place") - F.col("last")).cast("int").alias("start"),
        F.when(copy, F.col("place") + F.col("right")).otherwise(F.col("place") - F.col("first") + window).cast("int").alias("end"))
    return small.union(large).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = 50, prefix: int = 16, group_rows: int = 500) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, sha): `kept` is the kept words joined by one space,
    or null where nothing was removed and `sha` alone is known; sha is its SHA-256."""
    scanned = cut(scan(docs, window, prefix))
    spans = cut(repeated_spans(docs, scanned, window, prefix, group_rows))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))

    def run(batches):
        for b in batches:
            removed, kept, sha = [], [], []
            for r in b.select(["text", "spans"]).to_pylist():
                words = r["text"].encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words) + 1, np.int32)
                for s in r["spans"]:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                stay = np.flatnonzero(gone.cumsum()[:-1] == 0)
                out = b" ".join([words[i] for i in stay.tolist()])
                removed.append(len(words) - len(stay))
                kept.append(out.decode("utf-8", "surrogatepass"))
                sha.append(hashlib.sha256(out).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())],
                                             ["_id", "_row", "n_removed", "kept", "_sha"])

    cut_texts = texts.join(spans.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "row", "text", "spans")
    cut_texts = cut_texts.mapInArrow(run, "_id long, _row long, n_removed long, kept string, _sha string").dropDuplicates(["_id", "_row"])
    whole = scanned.select("doc_id", "row", "n_words", "sha")
    own = whole.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy(F.col("sha").alias("_of")).agg(F.min("doc_id").alias("_least"))
    whole = whole.join(own, F.col("sha") == F.col("_of"), "left")
    whole = whole.join(cut_texts, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))
    return whole.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "sha")).alias("sha"))
