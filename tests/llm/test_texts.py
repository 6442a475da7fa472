"""Operators on documents against brute force, on nulls, blanks, copies, repeated rows and clashing names."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bpe, line_dedup, quality_rules, simhash, substring_dedup, token_counts

from llm_data import LOWER, TEXTS, docs, key, shipped, words  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def line_answer(texts, min_docs=5):
    held = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    assert rows(out, "doc_id", "n_lines", "n_dropped", "kept_text") == line_answer(TEXTS)


def test_line_dedup_many_lines_and_blocks(spark):
    shared = [f"shared line number {i:04d} that is long enough to count" for i in range(300)]
    texts = [(d, "\n".join(x for i, x in enumerate(shared) if (i * 7 + d) % 3)) for d in range(9)]
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows(out, "doc_id", "n_lines", "n_dropped", "kept_text") == line_answer(texts)


def substring_answer(texts, window):
    least = {}
    for i, t in texts:
        w = words(t)
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a:a + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[a:a + window])] < i:
                gone[a:a + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_rows", [2_000, 1, 2])
def test_substring_dedup(docs, group_rows):
    out = substring_dedup.dedup_substrings(docs, group_rows=group_rows)
    assert rows(out, "doc_id", "n_words", "n_removed", "sha") == substring_answer(TEXTS, 50)


@pytest.mark.parametrize("group_rows", [2_000, 3, 1])
def test_substring_dedup_random(spark, group_rows):
    rng = np.random.default_rng(5)
    source = rng.integers(0, 30, 900)
    texts = []
    for d in range(40):
        parts = [source[a:a + n] for a, n in zip(rng.integers(0, 800, 4), rng.integers(5, 90, 4), strict=True)]
        texts.append((d, " ".join(f"t{x}" for x in np.concatenate(parts))))
    out = substring_dedup.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string"), group_rows=group_rows)
    answer = substring_answer(texts, 50)
    assert sum(x[2] for x in answer) > 100
    assert rows(out, "doc_id", "n_words", "n_removed", "sha") == answer


def statistics(text):
    w, t = words(text), text or ""
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics(docs):
    got = rows(quality_rules.text_statistics(docs), "doc_id", *quality_rules.STATISTICS)
    assert got == sorted(((i, *statistics(t)) for i, t in TEXTS), key=repr)


def test_learned_rules(spark):
    """Documents full of symbols are labelled bad; the list finds the symbols and keeps the rest."""
    texts = [(i, " ".join(("bad##" if i % 4 == 0 else "good") + f"{(i * 31 + j) % 997}" for j in range(60 + i % 40))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(None, 0, 0), (5, None, 0), (9999, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(out[i]["kept"] == (i % 4 > 0) for i in range(400))
    assert "symbols_per_word" in out[0]["rule"]
    empty = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] for r in empty)
    assert quality_rules.judge(docs.limit(0), labels).collect() == []


def test_bpe_codec(docs):
    out = bpe.decode(bpe.encode(docs, PATH, keep=["doc_id", "text"]), PATH)
    for r in out.collect():
        assert r["ids"] == LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == LIBRARY.decode(r["ids"], skip_special_tokens=False) == (r["text"] or "")
    got = rows(bpe.digests(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in TEXTS]
    assert got == sorted(((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in ids), key=repr)


def _fuzz(n, size):
    chars = "ab  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　é日½²٣'st.,<|>endoftext0123\U0001F600́\0"
    rng = np.random.default_rng(3)
    return ["".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(0, size))) for _ in range(n)] + ["<|endoftext|>" * 9, "q" * 999, " " * 99]


def test_bpe_fuzz():
    texts = _fuzz(500, 40)
    voc = bpe.Vocabulary(PATH, cache_bytes=20_000)
    for step in (1, 1 << 20):
        got = [np.frombuffer(x, np.int32).tolist() for x in voc.encode_batch(texts, step)]
        assert got == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        assert voc.cached <= 20_000 and voc.cached == sum(200 + len(p) + len(x) for p, x in voc.cache.items())
    voc.forget()
    assert not voc.cache


def test_bpe_long_pieces():
    """Unbroken pieces, alone and many, equal the library; the flat tree needs n log n steps."""
    rng = np.random.default_rng(4)
    texts = ["a" * 20_000, "".join(map(chr, rng.integers(97, 123, 30_000))), "é" * 3001, "".join(map(chr, rng.integers(97, 100, 129)))]
    texts += ["".join(map(chr, rng.integers(97, 100, 200 + i))) for i in range(50)]
    voc = bpe.Vocabulary(PATH)
    got = [np.frombuffer(x, np.int32).tolist() for x in voc.encode_batch(texts)]
    assert got == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    for n in (1, 2, 3, 7, 8, 9):
        piece = ("lo" * n)[:n + 1].encode()
        assert voc.merge_one(piece) == voc.merge_all([piece.decode()])[0]


def test_token_counts(docs):
    out = token_counts.count_tokens(docs, PATH, keep=["doc_id", "n_words"], chunk_chars=64, overlap_chars=4)
    want = sorted(((i, len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS), key=repr)
    assert rows(out, "doc_id", "n_tokens") == want


def test_token_counts_widen():
    counter = token_counts.Counter(PATH, 50, 4)
    texts = _fuzz(300, 400)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert counter.widened > 0


def slow_fingerprint(text):
    w = words((text or "").translate(LOWER))
    runs = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_answer(points, distance):
    """{point: smallest id reachable} by comparing all pairs."""
    ids = sorted(points)
    of = {i: i for i in ids}
    while True:
        new = {i: min(of[j] for j in ids if (points[i] ^ points[j]).bit_count() <= distance) for i in ids}
        if new == of:
            return of
        of = new


def test_simhash(docs):
    out = simhash.near_duplicates(docs).collect()
    prints = {i: slow_fingerprint(t) for i, t in TEXTS if i is not None}
    assert {r["doc_id"]: r["fp"] % 2 ** 64 for r in out} == prints
    assert {r["doc_id"]: r["component_id"] for r in out} == component_answer(prints, 4)
    assert len(out) == sum(i is not None for i, _ in TEXTS)


@pytest.mark.parametrize("cell_rows", [4096, 5])
def test_simhash_links(spark, cell_rows):
    """Random centres with points a few bits away, chains among them; large cells in blocks."""
    rng = np.random.default_rng(2)
    points = {}
    for c in range(12):
        p = int(rng.integers(0, 1 << 63))
        for k in range(14):
            points[c * 100 + k] = p
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                p ^= 1 << int(b)
            if k % 5 == 4:
                p ^= 0x1F << int(rng.integers(0, 50))
    rows_ = [(int(np.uint64(p).astype(np.int64)), i) for i, p in points.items()]
    nodes = spark.createDataFrame(rows_, "fp long, first long").groupBy("fp").agg(F.min("first").alias("first"))
    found = simhash.components(simhash.links(nodes, 4, cell_rows=cell_rows), nodes)
    got = {r["fp"]: r["c"] for r in nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "first").alias("c")).collect()}
    want = component_answer(points, 4)
    assert {i: got[fp] for fp, i in rows_} == want


def test_simhash_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    gap = simhash.manhattan(simhash.embed(a), simhash.embed(b))
    counts = [np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(3)) for s in range(0, 64, 2)]).astype(int) for x in (a, b)]
    assert (gap == np.abs(counts[0] - counts[1]).sum(axis=0)).all() and (gap <= np.bitwise_count(a ^ b)).all()


def test_empty_tables(docs):
    none = docs.limit(0)
    for out in (line_dedup.dedup_lines(none), substring_dedup.dedup_substrings(none), bpe.digests(none, PATH),
                token_counts.count_tokens(none, PATH), simhash.near_duplicates(none), quality_rules.text_statistics(none)):
        assert out.collect() == []
