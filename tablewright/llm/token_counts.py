"""Token counts by overlap resynchronisation.

A text longer than `chunk_chars` is encoded in chunks that overlap, each with
the byte offsets of its tokens.  Two neighbours are spliced at a common token
boundary that is proven stable: the byte-level split pattern has white space
only before other characters of a piece, so a piece starts wherever white space
follows something else, whatever stands further left or right, and no special
token holds white space.  If the overlap has no such place, or the encodings
disagree on it, the overlap is doubled, at last up to the end of the text.

Memory holds one text and the tokens of two chunks.  Defined results: null text
is empty (0 tokens); special strings in a text count as the special tokens they
spell; repeated rows are each counted.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, STABLE, TEXT, byte_alphabet


class Counter:
    """Counts tokens of a byte-level BPE vocabulary (.json of the public tokenizers library)."""

    def __init__(self, path: str, chunk_chars: int = 1 << 15, overlap_chars: int = 256):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in {
            x["content"] for x in file.get("added_tokens", [])}}
        special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.length = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.length[i] = len(t)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.widened = 0  # overlaps that had to grow

    def _encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all", disallowed_special=())

    def _starts(self, text: str) -> np.ndarray:
        """Byte offset of each token's start, and the end."""
        return np.concatenate(([0], np.cumsum(self.length[self._encode(text)])))

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self._encode(text))
        total, at, here = 0, 0, self._starts(text[:self.chunk + self.overlap])
        begin, size, overlap = 0, self.chunk + self.overlap, self.overlap  # the chunk is text[begin:begin + size]
        while begin + size < len(text):
            cut = begin + size - overlap
            after = self._starts(text[cut:cut + self.chunk + self.overlap])
            splice = self._splice(text, begin, cut, begin + size, here, after)
            if splice is None:
                self.widened += 1
                size, overlap = size + overlap, 2 * overlap
                here = self._starts(text[begin:begin + size])
                continue
            total += splice[0] - at
            at, here, begin = splice[1], after, cut
            size, overlap = self.chunk + self.overlap, self.overlap
        return total + len(here) - 1 - at

    def _splice(self, text, begin, cut, end, left, right):
        """Token numbers of the first stable common boundary in text[cut:end], or None."""
        shift = len(text[begin:cut].encode("utf-8", "surrogatepass"))
        for m in STABLE.finditer(text, cut, end):
            if m.start() <= cut:
                continue
            b = len(text[cut:m.start()].encode("utf-8", "surrogatepass"))
            i, j = np.searchsorted(left, shift + b), np.searchsorted(right, b)
            if i < len(left) and j < len(right) and left[i] == shift + b and right[j] == b:
                return int(i), int(j)
        return None


_LOADED: dict = {}


def counter(path: str, chunk_chars: int, overlap_chars: int) -> Counter:
    key = (path, chunk_chars, overlap_chars)
    if key not in _LOADED:
        _LOADED[key] = Counter(*key)
    return _LOADED[key]


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens", keep: list[str] | None = None,
                 chunk_chars: int = 1 << 15, overlap_chars: int = 256) -> DataFrame:
    """`keep` (default: all columns but `name`) and the number of tokens of the whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text].cast("string"), F.lit("")).alias(TEXT))
    schema = rows.drop(TEXT).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches):
        c = counter(path, chunk_chars, overlap_chars)
        for b in batches:
            texts = b.column(b.schema.names.index(TEXT))
            n = pa.array([c.count(t.as_py()) for t in texts], pa.int64())
            names = [x for x in b.schema.names if x != TEXT]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(x)) for x in names], n], [*names, name])

    return rows.mapInArrow(run, schema)
