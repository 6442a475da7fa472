"""License scans, centroid clustering and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import LOWER, docs, shipped  # noqa: F401
from tablewright.llm import clustering, license_scan, spelling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
NOTES = [
    (1, None), (2, ""), (3, " ?! "), (4, "Released UNDER the MIT-License."), (5, "x " * 70 + MIT.replace(" a ", " one ") + " y" * 200),
    (6, "under the mit license " * 3 + "apache license, version 2.0"), (6, "under the mit license " * 3 + "apache license, version 2.0"),
    (7, "Licensed under\nCC BY-NC\n4.0"), (8, "under the mit license"), (9, "mitlicense under the mit licenses"), (None, "cc by nc é"),
    (10, "cc by nc by nc cc by nc"), (11, MIT.replace("Permission", "x").replace("granted", "y")), (12, "word " * 30_000 + "under the MIT license"),
    (13, "the gnu general public license of this work is licensed under version 2"), (14, "é日本 licensed"),
]


def license_answer(text, templates, threshold):
    words = WORD.findall((text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                places.append(i)
                base.add(label)
    sets = [(label, set(WORD.findall(t.translate(LOWER))), len(WORD.findall(t))) for label, t in templates]
    step = max(n for *_, n in sets)
    labels, best = set(base), Fraction(0)
    for at in range(0, len(words), step):
        block = set(words[at:at + 2 * step])
        for label, s, _ in sets:
            share = Fraction(len(block & s), len(s))
            if share >= threshold:
                labels.add(label)
                best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1.0 if places else float(best))


@pytest.mark.parametrize("threshold", [license_scan.THRESHOLD, Fraction(1, 2), Fraction(1)])
def test_license_scan(spark, threshold):
    names = ["row", "ids", "labels", "n_words", "score", "blocks", "b_row"]
    rows = [(i, t, *names) for i, t in NOTES]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    got = sorted((tuple(r) for r in license_scan.scan(frame, threshold=threshold).collect()), key=repr)
    assert got == sorted(((i, *license_answer(t, license_scan.TEMPLATES, threshold)) for i, t in NOTES), key=repr)
    if threshold == license_scan.THRESHOLD:
        by = {r[0]: r[6] for r in got}
        assert by[5] == "mit" and by[7] == "cc-by-nc" and by[11] == "" and by[4] == "mit" and by[13] == "gpl"
    assert license_scan.scan(frame.limit(0)).collect() == []


def test_license_join_is_exact(spark):
    """Random blocks and templates: the filters lose no pair and let no other through."""
    rng = np.random.default_rng(7)
    templates = [(f"t{k % 9}", " ".join(f"w{x}" for x in rng.integers(0, 25, rng.integers(1, 16)))) for k in range(25)]
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 90)))) for i in range(120)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for threshold in (Fraction(7, 10), Fraction(9, 10)):
        got = sorted(tuple(r) for r in license_scan.scan(frame, templates, threshold=threshold).collect())
        want = sorted((i, *license_answer(t, templates, threshold)) for i, t in texts)
        assert got == want and 10 < sum(bool(x[6]) for x in want) < 119
    with pytest.raises(ValueError):
        license_scan.scan(frame, threshold=0)
    assert all(r["labels"] == "" for r in license_scan.scan(frame, templates=[], phrases={}).collect())


def lloyd(vectors, k, rounds, seed):
    """{row: (cluster, distance)} and centroids, with Python's integers."""
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    return [(i, *nearest(v)[::-1]) for i, v in vectors], centroids


@pytest.mark.parametrize("n, k, pivots", [(300, 8, 6), (300, 8, 2), (5, 8, 6), (40, 3, 1)])
def test_clustering(spark, n, k, pivots):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 6))
    values = [(i // 2 if i % 7 == 0 else i, (centres[i % 5] + rng.normal(size=6) * (0.1 if i % 3 else 3)).tolist(), "x") for i in range(n)]
    values += [(None, values[0][1], "x"), values[1], values[1], (7, None, "x"), (8, [1.0] * 5, "x"), (9, [1.0] * 5 + [None], "x"),
               (10, [float("nan")] * 6, "x"), (11, [float("inf")] * 6, "x"), (12, [1e300] * 6, "x")]
    frame = spark.createDataFrame(values, "vec_id long, embedding array<double>, v string").repartition(4)
    kept = [(i, tuple(int(np.floor(1024 * x)) for x in e)) for i, e, _ in values if e and len(e) == 6 and all(x is not None and abs(x) < 1e10 for x in e)]
    found, centroids = clustering.cluster(clustering.quantized(frame, size=6), k=k, rounds=4, n_pivots=pivots)
    want, last = lloyd(kept, k, 4, 3)
    assert centroids.tolist() == last
    out = clustering.with_inertia(found, centroids).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out), key=repr) == sorted(want, key=repr)
    assert {r["inertia"] for r in out} == {sum(d for *_, d in want)}
    for r in out:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, last[r["cluster"]])).encode()).hexdigest()


def test_clustering_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, centroids = clustering.cluster(clustering.quantized(none))
    assert clustering.with_inertia(found, centroids).collect() == [] and len(centroids) == 0


def test_ptolemaic_bounds():
    """Bounds never pass the true distance, come close to it, and spare most distances of separate groups."""
    rng = np.random.default_rng(3)
    for scale in (1, 1000, clustering.LIMIT):
        rows = rng.integers(-scale, scale + 1, (200, 64))
        pivots, c = rows[:5], rows[7]
        pairs = clustering.pivot_pairs(pivots)
        to = np.sqrt(np.stack([clustering.squared(rows, p) for p in pivots], axis=1).astype(float))
        bound = clustering.lower_bounds(to, np.sqrt(clustering.squared(pivots, c).astype(float)), pairs)
        exact = [sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for r in rows]
        assert all(Fraction(float(b)) ** 2 <= d for b, d in zip(bound, exact, strict=True))
        assert bound.max() > 0.3 * max(exact) ** 0.5
    centres = rng.integers(-5000, 5000, (8, 64))
    rows = centres[rng.integers(0, 8, 4000)] + rng.integers(-20, 21, (4000, 64))
    pivots = centres[:6]
    to = np.sqrt(np.stack([clustering.squared(rows, p) for p in pivots], axis=1).astype(float))
    cluster, best, done = clustering.nearest(rows, to, centres, pivots, clustering.pivot_pairs(pivots))
    every = np.stack([clustering.squared(rows, c) for c in centres], axis=1)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert done < 0.5 * 8 * len(rows)


def edits(a, b):
    """True if one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_answer(texts):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def spelling_texts(seed):
    rng = np.random.default_rng(seed)
    letters = list("abÉéñt")
    stems = ["".join(rng.choice(letters, rng.integers(6, 10))) for _ in range(60)]
    texts = [(None, "Straße naïveté naïveté"), (0, None), (1, ""), (2, "short words only 1234567 _______")]
    for d in range(40):
        words = []
        for _ in range(150):
            w = list(stems[min(rng.geometric(0.08), 60) - 1])
            while rng.random() < 0.25:
                at = rng.integers(0, len(w))
                w[at:at + int(rng.integers(0, 2))] = [rng.choice(letters)] * int(rng.integers(0, 3))
            words.append("".join(w))
        texts.append((d + 3, " ".join(words) + " ,-" + "".join(words[:2])))
    # a chain of forms: each has ten times the count of the one before
    return texts + [(500, "abcdefgh " + "abcdefgx " * 40 + "abcdefxx " * 500), (500, "abcdefgh"), (501, "ABCDEFXX×÷")]


@pytest.mark.parametrize("chunk_rows", [5000, 3, 1])
def test_spelling(spark, chunk_rows):
    texts = spelling_texts(1)
    names = ["word", "n", "form", "i", "j", "chunk", "length"]
    frame = spark.createDataFrame([(i, t, *names) for i, t in texts], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    got = sorted(tuple(r) for r in spelling.group_variants(frame, chunk_rows).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = spelling_answer(texts)
    assert got == want
    assert any(r[1] not in (None, r[2]) for r in want) and max(r[4] for r in want) > 5
    assert spelling.group_variants(frame.limit(0)).collect() == []


def test_composition_finds_each_pair_once():
    rng = np.random.default_rng(9)
    for _ in range(60):
        words = sorted({"".join(rng.choice(list("ab"), rng.integers(2, 7))) for _ in range(rng.integers(2, 40))})
        fst = spelling.Acceptors()
        for short in range(2, 7):
            a, b = [w for w in words if len(w) == short], [w for w in words if len(w) == short + 1]
            p, q = (fst.add(x) if x else None for x in (a, b))
            if a:
                assert sorted(fst.rest(p)) == a
                got = sorted(tuple(sorted(x)) for x in fst.replaced(p, p))
                assert got == sorted((u, v) for u in a for v in a if u < v and edits(u, v))
            if a and b:
                assert sorted(fst.inserted(p, q)) == sorted((u, v) for u in a for v in b if edits(u, v))


def test_acceptor_is_minimal():
    """Words with the same ends share states: tops and stops need no state twice."""
    fst = spelling.Acceptors()
    start = fst.add(["stop", "stops", "top", "tops"])
    assert sorted(fst.rest(start)) == ["stop", "stops", "top", "tops"] and len(fst.arcs) == 6


def test_first_lines_are_streamed(spark):
    """The plan keeps the range partitioning and the sort by document and place under the window."""
    from tablewright.llm import line_dedup
    rows = spark.range(1000).selectExpr("id % 50 AS h1", "id % 7 AS h2", "id % 90 AS doc_id", "cast(id as int) AS place")
    plan = line_dedup.repeated_lines(rows, 2)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "rangepartitioning(h1" in below and "hashpartitioning" not in below
    assert "Sort [h1" in below and "place" in below[below.index("Sort [h1"):].split("\n")[0]
