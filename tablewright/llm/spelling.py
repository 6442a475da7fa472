"""Spelling variants by finite-state composition: vocabulary, one edit, vocabulary.

Two words are near if exactly one code point is inserted, deleted or replaced.
Pairs are the accepted pairs of the composition A o E o A of the vocabulary's
minimised acceptor A with a transducer E that copies all but one code point.  A
state of the composition is (p, edits made, q); before the edit both sides read the
same code points, behind it both must accept the same rest.

The composition is dealt out by initial states.  A pair with the shorter length c
either shares its first m = c // 2 code points, and then lies in the part of the
composition that starts in the state behind that prefix, or it shares its last
c - m ones: one edit cannot touch both.  So every word goes to the partition of its
prefix (A) and to that of its ending (A read backwards), for c = its length and
c = its length - 1.  A partition of more than `chunk_rows` words is cut into chunks
by a hash, and each two chunks are composed with each other, so a task holds the
acceptors of two chunks whatever a prefix holds; all pairs are still found, each
once.

Counting is combined in the tasks before words move, near words are aggregated
partially, and forms are followed by pointer doubling (a form has at least ten times
the count, so a chain has no more steps than the largest count has digits).

Defined results: null or empty text has no words; a null doc_id is written as
nothing before the colon of the hashed string; repeated rows count again; ties of
forms go to the smallest word in code-point order; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_groups

LEAST = 7
FACTOR = 10


def varied(doc_id: int | None, text: str | None, least: int = LEAST, every: int = 31) -> Counter:
    """The words of one document with their counts: where `every` divides a run's crc32 with
    the document's id, the run has lost one code point."""
    # bytes.lower() changes A-Z only; a match of `least` or more is a maximal run
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs = Counter(re.findall("[a-zÀ-ÿ]{%d,}" % least, low))
    first = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # all such runs are taken out first: what one has become may be spelled like another of them
    for run, n in [(r, runs.pop(r)) for r in list(runs) if zlib.crc32(r.encode(), first) % every == 0]:
        at = zlib.crc32(run.encode(), first) % len(run)
        if len(run) > least:
            runs[run[:at] + run[at + 1:]] += n
    return runs


def vocabulary(docs: DataFrame, least: int = LEAST, min_count: int = 2, hold: int = 100_000) -> DataFrame:
    """(word, n) of the words with at least `min_count` occurrences; a task holds `hold` words."""
    def run(batches):
        counts: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
            counts.clear()

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                counts.update(varied(i.as_py(), t.as_py(), least))
                if len(counts) >= hold:
                    yield from out()
        yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptors:
    """Minimised acceptors of finite word sets; equal states are one number across all of them.
    Nothing here recurses: a word may have any length."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []  # of each state: code point -> state
        self.final: list[bool] = []
        self._number: dict = {}
        self._both: dict[tuple[int, int, str], list[str]] = {}

    def _close(self, path: list, word: str, upto: int) -> None:
        """Number the states along `word` behind its place `upto`; nothing is added to them any more."""
        while len(path) - 1 > upto:
            final, arcs = path.pop()
            path[-1][1][word[len(path) - 1]] = self._state(final, arcs)

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        state = self._number.get(key)
        if state is None:
            state = self._number[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def add(self, words: list[str]) -> int:
        """The state that accepts the words (sorted, different)."""
        path: list = [[False, {}]]  # the open states along the last word: [final, arcs]
        last = ""
        for w in words:
            same = 0
            for c, d in zip(last, w):
                if c != d:
                    break
                same += 1
            self._close(path, last, same)
            path += [[False, {}] for _ in range(len(w) - same)]
            path[-1][0] = True
            last = w
        self._close(path, last, 0)
        return self._state(*path[0])

    def rest(self, p: int) -> list[str]:
        """All strings accepted from p."""
        return self.common(p, p)

    def common(self, p: int, q: int, but: str = "") -> list[str]:
        """All strings accepted from both, but for those that begin with `but`: the composition behind the edit."""
        key = (p, q, but) if p < q else (q, p, but)
        if key in self._both:
            return self._both[key]
        out = self._both[key] = [""] * (self.final[p] and self.final[q])
        read: list[str] = []  # the code points on the way to the pair of states at work
        todo = self._onward(p, q, 0, but)
        while todo:
            p, q, depth, c = todo.pop()
            read[depth:] = c
            if self.final[p] and self.final[q]:
                out.append("".join(read))
            todo += self._onward(p, q, depth + 1)
        return out

    def _onward(self, p: int, q: int, depth: int, but: str = "") -> list[tuple[int, int, int, str]]:
        """The pairs of states one code point behind (p, q)."""
        a, b = self.arcs[p], self.arcs[q]
        if p != q and a.keys().isdisjoint(b):
            return []
        return [(x, b[c], depth, c) for c, x in a.items() if c in b and c != but]

    def replaced(self, p: int, q: int):
        """Pairs of words from p and from q that differ in one replaced code point; from p = q each once."""
        todo = [(p, q, "")]
        while todo:
            p, q, x = todo.pop()
            a, b = self.arcs[p], self.arcs[q]
            for c, p1 in a.items():
                if c in b:
                    todo.append((p1, b[c], x + c))
                for d, q1 in b.items():
                    if c < d or c != d and p != q:
                        for y in self.common(p1, q1):
                            yield x + c + y, x + d + y

    def inserted(self, p: int, q: int):
        """Pairs of a word from p and one from q that has one more code point, set in as far
        behind as it can stand, so that each pair comes once."""
        todo = [(p, q, "")]
        while todo:
            p, q, x = todo.pop()
            a, b = self.arcs[p], self.arcs[q]
            for d, q1 in b.items():
                if d in a:
                    todo.append((a[d], q1, x + d))
                for y in self.common(p, q1, d):
                    yield x + y, x + d + y


def near_in_partition(words: list[str], chunk: list[int], i: int, j: int, length: int, shared: str, backwards: bool):
    """Near pairs of one partition: words of `length` and `length` + 1 code points that all begin
    (or end) with `shared`, one of chunk `i` and one of chunk `j`."""
    m = length // 2
    fst, cut_off = Acceptors(), len(shared)
    sets: dict[tuple[int, bool], list[str]] = {}
    for w, c in zip(words, chunk, strict=True):
        sets.setdefault((c, len(w) > length), []).append(w[len(w) - cut_off - 1::-1] if backwards else w[cut_off:])
    start = {k: fst.add(sorted(v)) for k, v in sets.items()}
    jobs = []
    if (i, False) in start and (j, False) in start:
        jobs.append(fst.replaced(start[i, False], start[j, False]))
    for short, long in {(i, j), (j, i)}:
        if (short, False) in start and (long, True) in start:
            jobs.append(fst.inserted(start[short, False], start[long, True]))
    for job in jobs:
        for u, v in job:
            if backwards:
                u, v = u[::-1] + shared, v[::-1] + shared
                if u[:m] != v[:m]:  # else the pair is in the partition of its prefix
                    yield u, v
            else:
                yield shared + u, shared + v


def near_pairs(words: DataFrame, chunk_rows: int = 5000, least: int = LEAST) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words of `words` (word, n) once."""
    size = F.length("word")
    of_length = F.explode(F.array(size, size - 1)).alias("length")
    keyed = words.select("word", "n", of_length).where(F.col("length") >= least)
    sides = F.inline(F.array(F.struct(F.lit(False).alias("backwards"), F.expr("left(word, cast(length div 2 as int))").alias("shared")),
                             F.struct(F.lit(True).alias("backwards"), F.expr("right(word, cast(length - length div 2 as int))").alias("shared"))))
    keyed = keyed.select("word", "n", "length", sides)
    part = ["length", "backwards", "shared"]
    sizes = keyed.groupBy(*part).agg(F.count("*").alias("rows"), F.count_if(F.length("word") == F.col("length")).alias("short"))
    # a partition without two words, or without one of the shorter length, has no pair of its own
    sizes = sizes.where((F.col("rows") > 1) & (F.col("short") > 0)).select(
        *[F.col(c).alias("s_" + c) for c in part], F.ceil(F.col("rows") / chunk_rows).cast("int").alias("chunks"))
    cells = keyed.join(sizes, [F.col(c) == F.col("s_" + c) for c in part])
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    cells = cells.select("word", "n", *part, "chunk", other)
    cells = cells.select("word", "n", *part, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    by = [*part, "i", "j"]

    def run(batches):
        for table, group in whole_groups(batches, by):
            cols = {c: table.column(c).to_pylist() for c in table.column_names}
            out: dict[str, list] = {"a": [], "a_n": [], "b": [], "b_n": []}
            ends = [*(group[1:] != group[:-1]).nonzero()[0] + 1, len(group)]
            at = 0
            for end in ends:
                words, count = cols["word"][at:end], dict(zip(cols["word"][at:end], cols["n"][at:end], strict=True))
                for u, v in near_in_partition(words, cols["chunk"][at:end], *(cols[c][at] for c in ("i", "j", "length", "shared", "backwards"))):
                    for name, value in zip(out, (u, count[u], v, count[v]), strict=True):
                        out[name].append(value)
                at = end
                if len(out["a"]) > 50_000 or end == len(group):
                    yield pa.RecordBatch.from_pydict(out, pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())]))
                    out = {c: [] for c in out}

    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) from (word, form) by pointer doubling; `largest` is the largest count."""
    out = cut(forms.select("word", F.col("form").alias("root")))
    steps = max(1, math.floor(math.log10(max(largest, 1))))  # each form has ten times the count
    for _ in range(math.ceil(math.log2(steps))):
        onward = out.select(F.col("word").alias("via"), F.col("root").alias("onward"))
        out = cut(out.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("onward", "root").alias("root")))
    return out


def group_variants(docs: DataFrame, chunk_rows: int = 5000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = cut(vocabulary(docs))
    pairs = near_pairs(words, chunk_rows)
    sides = F.inline(F.array(F.struct(F.col("a").alias("near_word"), F.col("a_n").alias("own_n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                             F.struct(F.col("b").alias("near_word"), F.col("b_n").alias("own_n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    near = pairs.select(sides).groupBy("near_word", "own_n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best"))
    takes = -F.col("best.minus") >= FACTOR * F.col("own_n")
    near = cut(near.select("near_word", "n_near", F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n")))
    largest = words.agg(F.max("n")).first()[0] or 0
    ends = roots(near.where(F.col("form").isNotNull()).select(F.col("near_word").alias("word"), "form"), largest)
    out = words.join(near, F.col("word") == F.col("near_word"), "left")
    out = out.join(ends.select(F.col("word").alias("end_word"), "root"), F.col("word") == F.col("end_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
