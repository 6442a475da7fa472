"""Byte-level BPE encoding and decoding with segment trees over pair ranks.

A piece (one match of the split pattern) is merged by a segment tree whose
leaves are the ranks of its adjacent pairs.  A node keeps rank and place in one
number, so the root is the leftmost pair of the lowest rank; a merge updates
three leaves and the paths above them, and the piece is done when the root has
no rank.  The trees of many pieces of like length are held as the columns of
one matrix and are worked in step; a few long pieces are worked one by one, each
in a flat tree, in n log n steps.  Pieces of a text are found by one call of the
pattern, and the ids of pieces met before in a task come from a cache bounded in
bytes, of which the older half goes when it is full and all at the task's end.
Decoding reads nothing but ids.

Defined results: null text is the empty text and has no ids; special tokens
written in a text become their ids, as the public tokenizers library does by
default; repeated rows are each encoded.  Memory holds one text, its ids and one
step of pieces; a text without white space is one step.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, sliced, text_bytes

#: The split pattern of the vocabulary's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of the pattern.  A piece has white space before other characters
#: only, so one always starts where white space follows something else, and no
#: special token holds white space: a text can be cut there.
SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
STABLE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")

#: Names of the library's own columns in a task; an input column of the same name is refused.
TEXT, IDS = "_tw_bpe_text", "_tw_bpe_ids"

#: Bytes of texts or ids that a task works at once.
SLICE = 4 << 20

_NONE = np.int64(1) << np.int64(62)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Decoder:
    """The bytes of every token of a vocabulary file, which is all that decoding needs."""

    def __init__(self, path: str):
        file = _read(path)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        tokens = {i: bytes(byte[c] for c in t) for t, i in file["model"]["vocab"].items()}
        tokens |= {x["id"]: x["content"].encode() for x in file.get("added_tokens", [])}
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_len = np.array([len(t) for t in every], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.flat = np.frombuffer(b"".join(every), np.uint8)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of `counts` ids."""
        if not len(ids):
            return [""] * len(counts)
        out = []
        ends = np.cumsum(counts)
        for at, end in zip(ends - counts, ends, strict=True):
            part = ids[at:end]
            n = self.token_len[part]
            to = np.cumsum(n)
            where = np.repeat(self.token_at[part] - (to - n), n) + np.arange(to[-1] if len(to) else 0)
            out.append(self.flat[where].tobytes().decode("utf-8", "replace"))
        return out


class Vocabulary:
    """A byte-level BPE vocabulary file (.json of the public tokenizers library)."""

    def __init__(self, path: str, cache_bytes: int = 24 << 20):
        file = _read(path)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.cache_bytes, self.cached = cache_bytes, 0

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        """{pair: rank}, for lone long pieces."""
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    @functools.cached_property
    def merged_list(self) -> list[int]:
        return self.merged.tolist()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or _NONE; ids below zero stand for no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of like length, and how many each has: one segment tree a
        column, merged in step."""
        n, width = len(pieces), max(map(len, pieces))
        leaves = 1 << max(1, (width - 1).bit_length())
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((width + 1, n), -1, np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        col = np.repeat(np.arange(n), length)
        ids[np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length), col] = self.of_byte[flat]
        after = np.repeat(np.arange(1, width + 2)[:, None], n, axis=1)  # next live place
        before = after - 2
        tree = np.full((2 * leaves, n), _NONE, np.int64)
        place = np.arange(width)[:, None]
        first = self.rank(ids[:-1], ids[1:])
        tree[leaves:leaves + width] = np.where(first < _NONE, first << 32 | place, _NONE)
        for level in range(leaves.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[a:2 * a] = np.minimum(tree[2 * a:4 * a:2], tree[2 * a + 1:4 * a:2])
        live = np.arange(n)

        def update(at, cols):
            """Recompute the leaves `at` and the paths above them."""
            right = np.minimum(after[at, cols], width)
            rank = self.rank(ids[at, cols], ids[right, cols])
            node = at + leaves
            tree[node, cols] = np.where(rank < _NONE, rank << 32 | at, _NONE)
            while node[0] > 1:
                node = node >> 1
                tree[node, cols] = np.minimum(tree[2 * node, cols], tree[2 * node + 1, cols])

        while True:
            root = tree[1, live]
            live, root = live[root < _NONE], root[root < _NONE]
            if not len(live):
                break
            at = root & 0xFFFFFFFF
            gone = after[at, live]
            ids[at, live] = self.merged[root >> 32]
            ids[gone, live] = -1
            follow = after[gone, live]
            after[at, live] = follow
            inside = follow <= width
            before[np.minimum(follow, width)[inside], live[inside]] = at[inside]
            update(gone, live)  # the merged-away place has no pair
            update(at, live)
            left = before[at, live]
            some = left >= 0
            if some.any():
                update(left[some], live[some])
        live = ids.T >= 0
        return ids.T[live].astype(np.int32), live.sum(axis=1)

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """Ids (int32, as bytes) of each piece; trees of like length are worked together."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        size = np.maximum(3, np.ceil(np.log2(np.maximum(length, 1)))).astype(np.int64)
        out: list = [None] * len(raw)
        for power in np.unique(size).tolist():
            group, most = np.flatnonzero(size == power), max(1, (1 << 19) >> power)
            for at in range(0, len(group), most):
                part = group[at:at + most].tolist()
                if power > 7 and len(part) < 32:  # lone long pieces
                    for i in part:
                        out[i] = self.merge_one(raw[i])
                    continue
                ids, n = self.merge([raw[i] for i in part])
                data, ends = ids.tobytes(), (4 * np.cumsum(n)).tolist()
                for i, x, y in zip(part, [0, *ends], ends, strict=False):
                    out[i] = data[x:y]
        return out

    def merge_one(self, piece: bytes) -> bytes:
        """Ids (int32, as bytes) of one piece, through a flat segment tree."""
        n, rank_of, merged = len(piece), self.rank_of, self.merged_list
        leaves = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        first = self.rank(ids[:-1], ids[1:])
        level = np.full(leaves, none, np.int64)
        level[:n - 1] = np.where(first < _NONE, first << 32 | np.arange(n - 1), none)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = np.concatenate([[none], *levels[::-1]]).tolist()
        ids, after, before = [*ids.tolist(), -1], list(range(1, n + 2)), list(range(-1, n))

        def update(at):
            """Recompute the leaf `at` and the path above it, up to the first node that stays."""
            a, b = ids[at], ids[after[at]] if after[at] < n else -1
            rank = rank_of.get(a << 32 | b) if a >= 0 and b >= 0 else None
            node = at + leaves
            value = none if rank is None else rank << 32 | at
            while tree[node] != value:
                tree[node] = value
                node >>= 1
                if not node:
                    break
                value = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            gone = after[at]
            ids[at], ids[gone] = merged[rank], -1
            after[at] = follow = after[gone]
            if follow < n:
                before[follow] = at
            update(gone)
            update(at)
            if before[at] >= 0:
                update(before[at])
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids (int32, as bytes) of all `pieces`, from the cache where they are there."""
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        special = [p for p in new if p[0] == "\0" and p[1:] in self.special]
        fresh = [p for p in new if not (p[0] == "\0" and p[1:] in self.special)]
        found = dict(zip(fresh, self.merge_all(fresh), strict=True))
        found |= {p: np.int32(self.special[p[1:]]).tobytes() for p in special}
        known = {p: cache[p] for p in pieces if p in cache} | found
        for p, ids in found.items():
            if len(p) <= 64:  # long pieces seldom come again
                cache[p] = ids
                self.cached += 200 + len(p) + len(ids)
        while self.cached > self.cache_bytes:
            for p in list(islice(cache, len(cache) // 2 + 1)):
                self.cached -= 200 + len(p) + len(cache.pop(p))
        return known

    def forget(self) -> None:
        """Empty the cache: workers live on after their tasks."""
        self.cache, self.cached = {}, 0

    def pieces(self, text: str) -> list[str]:
        """The text's pieces; a special token is one, marked by a leading NUL."""
        if self.specials is None or not self.specials.search(text):
            return self.split.findall(text)
        out = []
        for i, part in enumerate(self.specials.split(text)):
            out += ["\0" + part] if i % 2 else self.split.findall(part)
        return out

    def encode_batch(self, texts: list[str], step: int = 1 << 19) -> list[bytes]:
        """Ids (int32, as bytes) of each text, worked in steps of about `step` characters."""
        out, held, size = [b""] * len(texts), [], 0

        def flush():
            known = self.learn(set().union(*(p for _, p in held)))
            for i, pieces in held:
                out[i] += b"".join(map(known.__getitem__, pieces))
            held.clear()

        for i, t in enumerate(texts):
            at = 0
            while at < len(t):
                cut = STABLE.search(t, at + step) if len(t) - at > step else None
                end = cut.start() if cut else len(t)
                held.append((i, self.pieces(t[at:end])))
                size += end - at
                at = end
                if size >= step:
                    flush()
                    size = 0
        if held:
            flush()
        return out


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_LOADED: dict = {}


def vocabulary(path: str, kind=Vocabulary):
    """The file as `kind` needs it, read once a process."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = kind(path)
        give_back()
    return _LOADED[path, kind]


def _struct_of(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns but `ids`) and the text's ids as array<int>."""
    keep = [c for c in docs.columns if c != ids] if keep is None else keep
    rows = docs.select(*[docs[c] for c in keep if c != ids], F.coalesce(docs[text].cast("string"), F.lit("")).alias(TEXT))
    schema = rows.drop(TEXT).withColumn(ids, F.array().cast("array<int>")).schema

    def run(batches):
        voc = vocabulary(path)
        for b in sliced(batches, text_bytes(TEXT), SLICE):
            got = voc.encode_batch(_struct_of(b, TEXT).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in got]))).astype(np.int32)
            col = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))
            cols = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != TEXT]
            yield pa.RecordBatch.from_arrays([*cols, col], [n for n in b.schema.names if n != TEXT] + [ids])
        voc.forget()
        give_back()

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns but `text`) and the text of the ids (null: empty)."""
    keep = [c for c in rows.columns if c != text] if keep is None else keep
    rows = rows.select(*[rows[c] for c in keep if c != text], F.coalesce(rows[ids], F.array().cast("array<int>")).alias(IDS))
    schema = rows.drop(IDS).withColumn(text, F.lit("")).schema

    def run(batches):
        voc = vocabulary(path, Decoder)
        for b in sliced(batches, lambda b: 4 * _struct_of(b, IDS).value_lengths().to_numpy(), SLICE):
            col = _struct_of(b, IDS)
            flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            got = voc.decode_batch(flat[ends[0]:ends[-1]], np.diff(ends))
            cols = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != IDS]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.string())], [n for n in b.schema.names if n != IDS] + [text])
        give_back()

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, through encode and decode."""
    coded = encode(docs, path, keep=["doc_id"])
    coded = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    out = decode(coded, path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
