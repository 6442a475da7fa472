"""Findings of round three."""

import random
import re
import string
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import pyarrow as pa

from tablewright.functions import strings
from tablewright.llm import spelling
from tablewright.sources.files import read_csv

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def varied_by_contract(doc_id, text):
    out = Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text):
        run = run.translate(LOWER)
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7}


def test_varied_runs_that_meet():
    """A run that lost a code point may be spelled like another run that loses one, and is not varied again."""
    rng = random.Random(1)
    met = 0
    for doc_id in range(3000):
        runs = ["a" * rng.randint(6, 30) for _ in range(30)]
        cut = {r for r in runs if zlib.crc32(f"{doc_id}:{r}".encode()) % 31 == 0}
        met += any(r[1:] in cut for r in cut)
        assert spelling.varied(doc_id, " ".join(runs)) == varied_by_contract(doc_id, " ".join(runs))
    assert met


def test_near_words_of_thousands_of_letters(spark):
    size = 5000
    words = ["a" * size, "a" * (size + 1), "a" * (size - 3) + "baa", "b" + "a" * size, "ba" + "c" * size]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(frame).collect())
    w = words
    assert got == sorted([tuple(sorted(x)) for x in ((w[0], w[1]), (w[0], w[2]), (w[0], w[3]), (w[1], w[3]))])


def read_back(spark, path, first, later):
    """The rows of a file whose splits have `first` bytes while it is opened and `later` bytes when it is read."""
    keys = {"spark.sql.files.maxPartitionBytes": str(first), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = read_csv(spark, path, infer_types=False)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(later))
        return sorted((tuple(r) for r in out.collect()), key=lambda r: int(r[0]))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_splits_of_a_later_scan(spark, tmp_path):
    """Records do not depend on where the scan that returns them would cut a file."""
    rows = [(str(i), "\n".join(f"line {k}" for k in range(i % 7 + 1))) for i in range(60)]
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f'{a},"{b}"\n' for a, b in rows), encoding="utf-8")
    for first, later in ((64, 100), (64, 1 << 20), (1 << 20, 90)):
        assert read_back(spark, str(tmp_path / "a.csv"), first, later) == rows


def test_doubled_quotes_over_many_splits(spark, tmp_path):
    """Lines of a cell with an even number of quotes do not close it."""
    rows = [("1", "x"), ("2", "\n".join(f'say "{k}"' for k in range(40))), ("3", "y\nz")]
    text = "id,note\n" + "".join('{},"{}"\n'.format(a, b.replace('"', '""')) for a, b in rows)
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    assert read_back(spark, str(tmp_path / "a.csv"), 50, 50) == rows


def test_plain_file_is_not_kept(spark, tmp_path, monkeypatch):
    """Without a line break in a cell no copy is made, and the splits do not matter either."""
    monkeypatch.setattr("pyspark.sql.DataFrame.checkpoint", None)
    rows = [(str(i), f'a "{i}", b') for i in range(60)]
    text = "id,note\n" + "".join('{},"{}"\n'.format(a, b.replace('"', '""')) for a, b in rows)
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    assert read_back(spark, str(tmp_path / "a.csv"), 64, 100) == rows


def test_normalize_holds_one_slice_of_a_batch():
    """As Python strings only about a megabyte of a batch is held at a time; nulls and empty texts stay."""
    texts = ["Ünïcödé ﬁ ½ ſ Ａ ́ạ̇ 日本 😀 " * 400, None, "", "plain ASCII", "ß" * 50_000] * 600
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    try:
        out = strings._nfkd_ascii.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < batch.nbytes / 4
    assert out.to_pylist() == [t and unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert strings._nfkd_ascii.func(batch[:0]).to_pylist() == []


def test_normalize_as_a_column(spark):
    rows = [("é",), (None,), ("",), ("x ﬂ y",), ("plain",), ("ñ日",)]
    frame = spark.createDataFrame(rows, "t string").repartition(2)
    got = {r[0]: r[1] for r in frame.select("t", strings.normalize_ascii(frame["t"])).collect()}
    assert got == {"é": "e", None: None, "": "", "x ﬂ y": "x fl y", "plain": "plain", "ñ日": "n"}
