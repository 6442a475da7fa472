"""Operators on urls, pages, vectors and label mixes, and the pipeline, against brute force."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from llm_data import TEXTS, shipped  # noqa: F401
from tablewright.llm import html_extract, line_dedup, mixing, quality_rules, queries, simhash, topk, url_filter

from test_texts import component_answer, line_answer, sha, slow_fingerprint, statistics

URLS = [
    (1, "http://A.Example.net/en/1?x#y", "net/", None), (2, "https://example.net/de/1", None, None), (3, None, None, None),
    (4, "no scheme", None, None), (5, "http://example.com/de/", None, None), (6, "http://sub.example.com/de/x", None, None),
    (7, "http://notexample.com/de/x", None, None), (8, "ftp://a.org/fr/é", None, None), (9, "http://net", None, None),
    (10, "http://net/", None, None), (11, "x://y://z/w", None, None), (12, "://", None, None), (13, "http://a.NET?q/en/", None, None),
    (13, "http://a.NET?q/en/", None, None), (None, "http://example.net/en/", None, None),
]
EXPECTED = {1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/1", "net/", "block"),
            3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("example.com", "/de/", "example.com/de/", "block"),
            6: ("sub.example.com", "/de/x", "example.com/de/", "block"), 7: ("notexample.com", "/de/x", None, "allow"),
            8: ("a.org", "/fr/é", "org/fr/", "allow"), 9: ("net", "", None, "allow"), 10: ("net", "/", "net/", "block"),
            11: ("y:", "//z/w", None, "allow"), 12: ("", "", None, "allow"), 13: ("a.net", "", None, "allow"),
            None: ("example.net", "/en/", "example.net/en/", "allow")}


def test_url_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    out = url_filter.filter_urls(pages, labels).collect()
    assert len(out) == len(URLS)
    assert all(EXPECTED[r["page_id"]] == (r["host"], r["path"], r["rule"], r["verdict"]) for r in out)
    assert url_filter.filter_urls(pages.limit(0), labels).collect() == []
    assert len(url_filter.filter_urls(pages, labels.limit(0)).collect()) == len(URLS)


def test_url_reputation(spark):
    """One bad host among good ones is blocked; so is an unlabelled host of a bad domain."""
    hosts = [f"h{i}.good{i % 5}.test" for i in range(30)] + [f"b{i}.spam.test" for i in range(10)]
    pages = [(k, f"http://{h}/p", h) for k, h in enumerate(h for h in hosts for _ in range(40))]
    pages += [(100_000, "http://new.spam.test/", "new.spam.test"), (100_001, "http://new.good1.test/", "new.good1.test")]
    labels = [(k, int("good" in h), 0) for k, _, h in pages if k < 100_000]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, x string"),
                                 spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["host"]: r["verdict"] for r in out.collect()} == {h: "block" if "spam" in h else "allow" for h in {p[2] for p in pages}}


def test_url_labels_by_document_number(spark, tmp_path):
    """Labels follow the number in the url's path where page_id names another document."""
    hosts = [f"h{i}.good{i % 5}.test" for i in range(30)] + [f"b{i}.spam.test" for i in range(10)]
    ends = ["", "/", ".html", "?page=7&ref=x", "#top", "/?utm_source=feed"]
    named = list(enumerate(h for h in hosts for _ in range(40)))
    pages = [(1599 - k, f"http://{h}/en/{k}{ends[k % 6]}", "<p>") for k, h in named]  # page_id mirrors the numbers
    labels = [(k, int("good" in h), 0) for k, h in named]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op1_url_filter(spark, str(tmp_path)).collect()
    assert len(out) == len(pages)
    assert {r["host"]: r["verdict"] for r in out} == {h: "block" if "spam" in h else "allow" for h in hosts}
    urls = [("http://a/en/12", 12), ("http://a/12.html?x=3", 12), ("http://a/12/#4", 12), ("http://a/12/x", None), ("http://12", None),
            (None, None), ("no scheme/12", None), ("http://a/x12", None), ("http://a/99999999999999999999", None)]
    got = spark.createDataFrame(urls, "url string, want long").withColumn("got", url_filter.document_number(F.col("url"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_topk(spark):
    rng = np.random.default_rng(4)
    base = [rng.normal(size=8).tolist() for _ in range(30)]
    rows = [(i, base[int(rng.integers(0, 30))]) for i in range(400)] + [(401, None), (402, [1.0, None]), (403, [float("nan")]), (404, [float("inf")])]
    rows += [(405, []), (500, [1.0, 2.0]), (7, base[0]), (None, base[0]), (600, base[3]), (600, base[3])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, block_rows=50, block_queries=2)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, terms in {(i, tuple(v)) for i, v in whole if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(terms, v, strict=False)), i) for i, v in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    assert got == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_topk_saturates(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [-3e38, 1.0])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = topk.top_k(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(1, 2 ** 63 - 1), (2, -(2 ** 63))]


LONG = "This is a long sentence of the story, with commas, and it goes on for a while. " * 5
PAGE = (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>"
        f"Home</a></li></ul></nav><!-- ad --><div class='ad'>Buy now.</div><article><h1>Head &amp; line</h1><p>{LONG}<br>\n more<p><b>{LONG}"
        f"</article><aside>Other</aside><footer>&copy; x</footer></body></html>")
ANSWER = "\n\n".join(["Head & line", f"{LONG.strip()} more", LONG.strip()])
PLAIN = (f"<div class='top menu'><ul><li><a href=a>Home page</a></li><li><a href=b>About us</a></li></ul></div><div id=c1><h1>Title</h1><p>{LONG}</p>"
         f"<p>{LONG}</div><div class='comments'><p>I agree &amp; like it, indeed.</p></div><div class='cookie-notice'>We use cookies.</div>"
         "<form>Mail <input></form>")


def test_html(spark):
    rows = [(i, f"u{i}", PAGE, "x") for i in range(20)] + [(50, None, None, "x"), (51, "u", "", "x"), (52, "u", "<", "x"), (53, "u", PLAIN, "x"), (20, "u", PAGE, "x")]
    rows += [(54, "u", PAGE[:PAGE.index("Other")] + "<p class='unclosed", "x"), (None, "u", "bare text &lt;b&gt;", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, html_extract.fit(pages), ["page_id", "url"]).collect()}
    assert all(got[i] == ANSWER for i in [*range(21), 54])
    assert (got[50], got[51], got[52]) == ("", "", "<")
    assert got[None] == "bare text <b>"
    assert got[53].endswith("\n\n".join([LONG.strip(), LONG.strip()]))
    assert not any(x in got[53] for x in ("Home", "About", "agree", "cookies", "Mail"))
    none = pages.limit(0)
    assert html_extract.extract(none, html_extract.fit(none), ["page_id"]).collect() == []


@pytest.mark.parametrize("start", [
    "<html><head><title>T</title><body><nav>Home</nav>", "<html><head><title>T</title><meta charset=x><link href=y><nav>Home</nav>",
    "<head><noscript><link href=x></noscript><script>var a;</script>\n<body>", "<head><head><title>T</title><body>",
    "<head><noscript><body>", "<html><head><title>T</title></head><body>"])
def test_html_head_without_end_tag(start):
    """<body>, or the first tag that cannot stand in head, ends it: the article is read."""
    page = html_extract.Page(f"{start}<article><h1>Head</h1><p>{LONG}</article>")
    assert [t for t in page.text if t and t != "Home"] == ["Head", LONG.strip()]
    assert html_extract.extract_texts([f"{start}<article><h1>Head</h1><p>{LONG}</article>"], None) == [f"Head\n\n{LONG.strip()}"]


def test_near_duplicates_of_repeated_ids(spark, tmp_path):
    """Texts under one doc_id are told apart: a copy goes, the other text stays, equal rows stay once."""
    rng = np.random.default_rng(5)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(3))
    rows = [(5, a), (5, b), (3, a), (7, c), (7, c), (8, c), (5, b), (2, b + " more"), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    near = bin(slow_fingerprint(b) ^ slow_fingerprint(b + " more")).count("1") <= 4
    want = [(3, a), (7, c), (2, b + " more"), (None, a), (None, a)] + ([] if near else [(5, b)])
    assert Counter(map(tuple, out)) == Counter(want)
    docs = spark.createDataFrame([(5, a), (5, b), (3, a)], "doc_id long, text string")
    assert Counter(map(tuple, corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())) == Counter([(3, a), (5, b)])


def test_samples_are_gathered_after_the_scan(spark, monkeypatch):
    """The join with the labels keeps the scan's own tasks; only the sample is dealt to a few."""
    docs, labels = labelled(spark, 20)
    plans = []

    def seen(df):
        plans.append(spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        raise StopIteration

    monkeypatch.setattr(quality_rules, "cut", seen)
    with pytest.raises(StopIteration):
        quality_rules.learn_rules(quality_rules.labelled_sample(docs, labels))
    assert "Coalesce" not in plans[0] and "RoundRobinPartitioning(4)" in plans[0]


def test_html_text_ends_head():
    assert [t for t in html_extract.Page("<head><title>T</title> \n<style>p{}</style>Bare text<p>More").text if t] == ["Bare text", "More"]


def test_html_decoding_is_consistent():
    page = html_extract.Page(PAGE)
    rng = np.random.default_rng(0)
    best, score = [], rng.normal(size=len(page.tag))
    kept = page.decode(score)
    assert set(kept) <= set(page.text)
    nodes = [i for i, t in enumerate(page.tag) if t == "nav"]
    score[:] = 5.0
    score[nodes] = 5.0
    best = page.decode(score)
    assert len(best) == sum(bool(t) for t in page.text)


def labelled(spark, n=600):
    """Two vocabularies; toxic documents hold their own words."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(n):
        kind = i % 10
        stem = "bad" if kind == 0 else "poor" if kind == 1 else "good"
        rows.append((i, " ".join(f"{stem}{x}" for x in rng.integers(0, 40, 30 + i % 50)), "r"))
        if i < n // 2:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(n, None, "r"), (n + 1, " ", "r"), (None, "good1 good2", "r"), (3, rows[3][1], "r")]
    return (spark.createDataFrame(rows, "doc_id long, text string, rate string").repartition(3),
            spark.createDataFrame(labels + [(None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("total,min_rate", [(None, 0.0), ("cover", 1.0), (5000.0, 0.0)])
def test_mixing(spark, total, min_rate):
    docs, labels = labelled(spark)
    targets = {"good": 0.5, "poor": 0.3, "toxic": 0.2}
    out, domains = mixing.mix(docs, labels, targets, total=total, min_rate=min_rate)
    rows = out.select("_row.*", "_tokens", "_p", F.col("rate").alias("x"), "copies").collect()
    assert len(rows) == docs.count() and sorted(domains) == sorted(targets)
    own = {"good": "good", "poor": "poor", "bad": "toxic"}
    right = [own[r["text"].rstrip("0123456789").split(" ")[0].rstrip("0123456789")] == domains[int(np.argmax(r["_p"]))]
             for r in rows if (r["text"] or "").strip()]
    assert np.mean(right) > 0.95
    expected = [sum(r["x"] * r["_tokens"] * r["_p"][k] for r in rows) for k in range(3)]
    now = [sum(r["_tokens"] * r["_p"][k] for r in rows) for k in range(3)]
    goal = {None: sum(now), "cover": max(now[k] / targets[d] for k, d in enumerate(domains))}.get(total, total)
    assert all(abs(e - targets[d] * goal) < 0.01 * goal for e, d in zip(expected, domains, strict=True))
    assert all(r["x"] >= min_rate and abs(r["copies"] - r["x"]) <= 1 for r in rows)
    copies = Counter()
    for r in rows:
        copies[domains[int(np.argmax(r["_p"]))]] += r["copies"] * r["_tokens"]
    assert all(abs(copies[d] / sum(copies.values()) - targets[d]) < 0.06 for d in domains)


def drawn(shares, sharp, n=2000):
    """Tokens and posteriors (three decimals) of documents of three domains."""
    rng = np.random.default_rng(0)
    kind = rng.choice(3, n, p=shares)
    p = np.exp(rng.normal(0, 0.5, (n, 3)) + sharp * np.eye(3)[kind]) * shares
    p = np.round(p / p.sum(axis=1, keepdims=True), 3)
    p[:, 0] = np.maximum(np.round(1 - p[:, 1] - p[:, 2], 3), 0)
    return rng.integers(20, 2000, n).astype(float), p


@pytest.mark.parametrize("shares,sharp,total,met", [
    ((0.998, 0.001, 0.001), 3.0, None, False), ((0.98, 0.01, 0.01), 2.0, None, True), ((0.98, 0.01, 0.01), 2.0, "cover", False),
    ((0.76, 0.127, 0.113), 0.1, "cover", False), ((0.76, 0.127, 0.113), 0.1, None, True)])
def test_rates_against_brute_force(spark, shares, sharp, total, met):
    """Rare domains and the cover case come as near to the targets as a long plain solve."""
    t, p = drawn(np.array(shares), sharp)
    want = np.array([0.85, 0.07, 0.08])
    least = 1.0 if total else 0.0
    now = p.T @ t
    goal = (now / want).max() if total else now.sum()
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "_tokens long, _p array<double>")
    rates = mixing.fit_rates(members, ["a", "b", "c"], dict(zip("abc", want.tolist(), strict=True)), total=total, min_rate=least)
    x = np.array([r[0] for r in members.select(rates.column(F.col("_p"))).collect()])
    gram = (p * t[:, None]).T @ p
    white = np.linalg.inv(gram + 1e-3 * np.diag(np.diag(gram)))

    def error(x):
        off = p.T @ (t * x) - want * goal
        return off @ white @ off

    slow, ahead, q = np.ones(len(t)), np.ones(len(t)), 1.0
    for _ in range(20_000):  # projected gradient with momentum
        step = np.maximum(ahead - p @ (white @ (p.T @ (t * ahead) - want * goal)), least)
        if error(step) > error(slow):
            q, ahead = 1.0, slow
            step = np.maximum(ahead - p @ (white @ (p.T @ (t * ahead) - want * goal)), least)
        r = (1 + math.sqrt(1 + 4 * q * q)) / 2
        slow, ahead, q = step, step + (q - 1) / r * (step - slow), r
    assert x.min() >= least
    assert error(x) <= 1.001 * error(slow) + 1e-9 * goal
    if met:
        assert np.allclose(p.T @ (t * x), want * goal, rtol=1e-4)


def test_label_sample_is_dealt_by_domain(spark):
    """A domain of one label in a hundred keeps all its labels in a sample a tenth of them, and the prior is that of all."""
    rows = [(i, ("rare" if i % 100 == 0 else "good") + f"{i % 7} word") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 100 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    sample = mixing.labelled_sample(docs, labels, mixing.DOMAINS, 1000, 64)
    assert {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()} == {"toxic": 100, "good": 900}
    model = mixing.fit_classifier(docs, labels, max_rows=1000)
    assert model.domains == ["good", "toxic"] and abs(model.prior[0] - math.log(1 / 99)) < 0.3
    assert mixing._quotas({"a": 5, "b": 50, "c": 900}, 100) == {"a": 5, "b": 47, "c": 48}


def test_mixing_without_labels(spark):
    docs, labels = labelled(spark, 20)
    out, domains = mixing.mix(docs, labels.limit(0))
    assert domains == ["all"] and {r["rate"] for r in out.select("rate").collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels)[0].collect() == []


def test_pipeline(spark, tmp_path):
    """run() against the stages done by hand, with the library's learned rules and rates."""
    rng = np.random.default_rng(11)
    texts = [(i, "\n".join(" ".join(f"{'zq' if i % 9 == 0 else 'k'}{x}" for x in rng.integers(0, 5000, 20)) for _ in range(5 + i % 7)))
             for i in range(200)]
    texts += [(300 + i, texts[i][1]) for i in range(1, 40)]
    shared = "this shared line is long enough to be found in many documents"
    texts = [(i, f"{t}\n{shared}" if i % 11 == 3 else t) for i, t in texts]
    texts += [(500 + i, texts[i][1].replace(" ", "# ")) for i in range(60)] + [(i + 1000 if i else None, t) for i, t in TEXTS]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(not 500 <= i < 560), int(i % 9 == 0)) for i, _ in texts if i is not None and i % 5], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())

    rules = quality_rules.learn_rules(quality_rules.labelled_sample(docs, labels))
    assert rules

    def fits(text):
        n, chars, symbols, dup, repeat = statistics(text)
        f = {"n_words": n, "mean_word": chars / n, "symbols_per_word": symbols / n, "dup_lines_per_word": dup / n, "repeat_share": repeat / n}
        return any(all(f[k] <= at if op == "<=" else f[k] > at for k, op, at in r.conditions) for r in rules)

    stats = [(i, t, statistics(t)) for i, t in texts]
    kept = [(i, t) for i, t, s in stats if not (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not fits(t)]
    assert not any(500 <= (i or 0) < 560 for i, _ in kept)
    kept = [(i, t) for i, _, _, t in line_answer(kept)]
    prints = {i: slow_fingerprint(t) for i, t in kept if i is not None}
    of = component_answer(prints, 4)
    kept = [(i, t) for i, t in kept if i is None or of[i] == i]
    assert not any(300 <= (i or 0) < 340 for i, _ in kept)
    frame = spark.createDataFrame(kept, "doc_id long, text string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frame, labels, total="cover", min_rate=1.0)[0].select("_row.doc_id", "copies").collect()}
    assert min(copies.values()) >= 1
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(t))] += copies[i]
    assert got == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert line_dedup.dedup_lines(docs).count() == simhash.fingerprints(docs).count() + 1
