"""Labels of the page trees from the pages' documents, and decoding against all consistent choices."""

import random
from itertools import product

import numpy as np
import pytest

from tablewright.llm import html_extract as H

WORDS = "river stone light carry market winter garden paper window simple north engine".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def made(rng, i, marks=True):
    """A page and its document: the markup says the opposite of the truth for every fourth page."""
    paragraphs = [sentence(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
    main, side = ("article", "aside") if i % 4 or not marks else ("aside", "article")
    if not marks:
        main = side = "div"
    menu = "".join(f"<li><a href=x>{rng.choice(WORDS)} {rng.choice(WORDS)} {i}</a></li>" for _ in range(6))
    page = (f"<html><body><ul>{menu}</ul><{main}>" + "".join(f"<p>{p}</p>" for p in paragraphs)
            + f"</{main}><{side}><a href=y>offer {i} now</a></{side}></body></html>")
    return page, "\n".join(paragraphs)


def test_labels_come_from_the_document_not_from_marks():
    rng = random.Random(1)
    for i in range(8):
        source, text = made(rng, i)
        page = H.Page(source)
        f = page.features()
        label = H.aligned_labels(page, f, text)
        for t, y in zip(page.text, label, strict=True):
            if t:
                assert y == (1 if t in text.split("\n") else 0)
        assert label[[j for j, t in enumerate(page.tag) if t == "ul"][0]] == 0
        own = H.markup_labels(page, f, None)
        both = (label >= 0) & (own >= 0)
        assert (label[both] == own[both]).all() == bool(i % 4)
    assert (H.aligned_labels(page, f, None) == -1).all() and (H.aligned_labels(page, f, "") == -1).all()
    short = H.Page("<p>light</p><p>two words</p><p>not there</p>")
    assert H.aligned_labels(short, short.features(), "a light of two words")[[i for i, t in enumerate(short.text) if t]].tolist() == [-1, -1, 0]


def test_trees_from_documents_read_pages_without_markup(spark):
    rng = random.Random(2)
    train = [made(rng, i) for i in range(60)]
    pages = spark.createDataFrame([(i, f"http://a/{i}.html", p) for i, (p, _) in enumerate(train)] + [(None, None, None), (3, "http://a/3.html", "<p>again")],
                                  "page_id long, url string, html string").repartition(3)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(train)] + [(5, None), (None, "x y z")], "doc_id long, text string")
    model = H.fit(pages, docs)
    held = [made(rng, i, marks=False) for i in range(20)]
    assert H.extract_texts([p for p, _ in held], model) == [t.replace("\n", "\n\n") for _, t in held]
    x, y = H.training_nodes(pages, docs)
    nearest, under = (x[:, H.FEATURES.index(c)] for c in ("nearest_mark", "under_other"))
    assert 0.05 < np.mean(((nearest > 0) & (under == 0)) != y) < 0.6  # the labels do not follow from the marks


def test_no_documents_fall_back_on_markup(spark):
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, f"http://a/{i}", made(rng, 1)[0]) for i in range(10)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "doc_id long, text string")
    a, b = H.fit(pages, none), H.fit(pages)
    probe = H.Page(made(rng, 1)[0]).features()
    assert (a.score(probe) == b.score(probe)).all()
    assert H.fit(pages.limit(0), none) is None


@pytest.mark.parametrize("seed", range(40))
def test_decoding_equals_all_consistent_choices(seed):
    """Every choice closed under parents is tried: none has more than the decoded one."""
    rng = random.Random(seed)
    page = H.Page("")
    for i in range(1, rng.randrange(2, 13)):
        parent = rng.choice([j for j in range(i) if page.tag[j] != "#run"])
        run = rng.random() < 0.6
        page._node("#run" if run else rng.choice(["div", "body", "ul"]), parent, 0, "x" * rng.randrange(1, 40) + str(i) if run else "", 0)
    score = np.array([rng.gauss(0, 3) for _ in page.tag])
    n = len(page.tag)

    def worth(i, kept):
        below = sum(worth(j, kept) for j in range(i + 1, n) if page.parent[j] == i and kept[j])
        if i == 0:
            return below
        vote = 0.0 if page.text[i] or page.tag[i] in ("html", "body") else np.clip(score[i], -4, 4) / 40
        return below * (1 + vote) + score[i] * np.sqrt(len(page.text[i]))

    choices = [(True, *k) for k in product([False, True], repeat=n - 1)]
    choices = [k for k in choices if all(not k[i] or k[page.parent[i]] for i in range(1, n))]
    best = max(worth(0, k) for k in choices)
    got = set(page.decode(score))
    mine = [k for k in choices if {t for t, x in zip(page.text, k, strict=True) if t and x} == got]
    assert mine and max(worth(0, k) for k in mine) == pytest.approx(best, abs=1e-9)
