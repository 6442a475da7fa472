"""License scans: phrases, and an exact set-similarity join against notice templates.

A text's words are cut into blocks of twice the longest template's words, a new
one every template length, so that every run of words as long as a template lies
whole in a block.  A template is found in a block that contains at least the
threshold share of its different words.  The join is exact:

* words of the templates are numbered by their count over all documents, rarest
  first (the global order);
* a template needs `need = ceil(threshold * size)` common words, so any block
  that has them shares one of the template's first `size - need + 1` words, found
  among its own words but for the last `need - 1` (prefix filter);
* a block with fewer than `need` template words is out (length filter);
* at the first common word, at places i and j, no more than
  1 + min(words after i, words after j) can be common (positional filter);
* pairs left are counted exactly.

Only blocks that hold a template's prefix word leave the scan, as arrays of word
numbers; blocks meet templates in a Spark join on that word.  Driver and tasks hold
the templates' words (at most `MAX_TEMPLATE_WORDS`), never anything of the corpus.

Defined results: null or empty text has no words; repeated rows and rows without
doc_id are each scanned; labels are distinct and sorted; the score is 1 where a
phrase stands, else the largest containment found, else 0; extra columns are left
behind.  Memory holds one text and its words.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices in the wording of the licences themselves; any list of (label, notice) may be given instead.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
]
THRESHOLD = Fraction(9, 10)
#: Bound of what the driver and each task hold of the templates.
MAX_TEMPLATE_WORDS = 1_000_000

#: A-Z to a-z; what is not a letter, a digit or beyond ASCII to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> tuple[list[int], set[str]]:
    """Word numbers at which a phrase starts (one per phrase and place), and their labels."""
    text = b" %s " % b" ".join(words)
    places, labels = [], set()
    for phrase, label in phrases.items():
        at, n, seen = text.find(phrase), 0, 0
        while at >= 0:
            n += text.count(b" ", seen, at)  # spaces before a place are words before it
            seen = at
            places.append(n)
            labels.add(label)
            at = text.find(phrase, at + 1)
    return places, labels


def _texts(batches):
    for b in batches:
        yield b, (t.as_py() for t in b.column(b.schema.names.index("text")))


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences over all documents of the vocabulary's words (a bounded result)."""
    def run(batches):
        counts: Counter = Counter()
        for _, texts in _texts(batches):
            for t in texts:
                counts.update(w for w in words_of(t) if w in vocabulary)
        yield pa.RecordBatch.from_pydict({"w": list(counts), "n": list(counts.values())}, pa.schema([("w", pa.binary()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in rows}


def prepared(templates, counts: dict[bytes, int], threshold: Fraction):
    """({word: number in the global order}, [(label, sorted numbers, words needed)])."""
    sets = [(label, set(words_of(t))) for label, t in templates]
    order = sorted(set().union(*(s for _, s in sets)), key=lambda w: (counts.get(w, 0), w))
    number = {w: i for i, w in enumerate(order)}
    return number, [(label, sorted(number[w] for w in s), -(-threshold.numerator * len(s) // threshold.denominator)) for label, s in sets if s]


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    threshold = Fraction(threshold)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    lengths = [len(words_of(t)) for _, t in templates]
    if sum(lengths) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    step = max([1, *lengths])
    named = {b" %s " % b" ".join(words_of(p)): label for p, label in phrases.items() if words_of(p)}
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    number, sets = prepared(templates, word_counts(rows, {w for _, t in templates for w in words_of(t)}), threshold)
    prefix = {w for _, ids, need in sets for w in ids[:len(ids) - need + 1]}
    least = min((need for *_, need in sets), default=0)

    def run(batches):
        get = number.get
        for b, texts in _texts(batches):
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")}
            for t in texts:
                words = words_of(t)
                places, labels = phrase_places(words, named)
                ids = list(map(get, words))
                hits = prefix.intersection(ids)
                places_of = [at // step for at, x in enumerate(ids) if x in hits] if hits else []
                near = sorted({k for at in places_of for k in (at, at - 1) if k >= 0})
                blocks = [sorted({x for x in ids[k * step:(k + 2) * step] if x is not None}) for k in near]
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(sorted(labels))
                out["blocks"].append([x for x in blocks if len(x) >= least])
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], ["doc_id", *out])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<array<int>>"
    scanned = cut(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    found = similar(scanned.select("row", F.explode("blocks").alias("ids")), sets)
    best = found.groupBy(F.col("row").alias("b_row")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = scanned.join(best, F.col("row") == F.col("b_row"), "left")
    both = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join(both, ",").alias("labels"), score.alias("score"))


def similar(blocks: DataFrame, sets: list[tuple[str, list[int], int]]) -> DataFrame:
    """(row, label, score) of every block and template that meet the template's need.

    `blocks` is (row, ids), ids ascending in the global order."""
    table = [(t, label, i, p, len(ids), need) for t, (label, ids, need) in enumerate(sets) for p, i in enumerate(ids[:len(ids) - need + 1])]
    prefixes = blocks.sparkSession.createDataFrame(table, "t int, label string, word int, i int, size int, need int")
    whole = blocks.sparkSession.createDataFrame([(t, ids) for t, (_, ids, _) in enumerate(sets)], "whole_t int, whole array<int>")
    least = min((need for *_, need in sets), default=1)
    each = blocks.select("row", "ids", F.size("ids").alias("length"), F.posexplode(
        F.slice("ids", F.lit(1), F.greatest(F.size("ids") - least + 1, F.lit(0)))).alias("j", "b_word"))
    near = (F.col("b_word") == F.col("word")) & (F.col("length") >= F.col("need")) & (
        1 + F.least(F.col("size") - 1 - F.col("i"), F.col("length") - 1 - F.col("j")) >= F.col("need"))
    pairs = each.join(prefixes, near).select("row", "ids", "t", "label", "size", "need").distinct()
    pairs = pairs.join(whole, F.col("t") == F.col("whole_t"))
    common = F.size(F.array_intersect("ids", "whole"))
    return pairs.where(common >= F.col("need")).select("row", "label", (common / F.col("size")).alias("score"))
