"""Quality rules: a learned decision list over text statistics.

`text_statistics` computes the statistics with built-in functions only.
`learn_rules` grows threshold conjunctions by sequential covering: each step
reads the class counts per (feature, bin) of the rows still covered, takes the
condition of the best information gain, prunes the conjunction on rows held out
from growing, and removes what the accepted rule covers.  `verdict` emits the
list as one ordered Spark conditional.

Defined results: null or blank text has zero words and fails the base rule; a
null label, or a label without a document, is not used for learning; documents
repeated under one doc_id are each judged; without usable labels the list is
empty and keeps everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, hold, words_of

#: Conditions may use these, all derived from the statistics.
FEATURES = {
    "n_words": lambda c: c("n_words"),
    "mean_word": lambda c: c("word_chars") / c("n_words"),
    "symbols_per_word": lambda c: c("n_symbols") / c("n_words"),
    "dup_lines_per_word": lambda c: c("n_dup_lines") / c("n_words"),
    "repeat_share": lambda c: c("n_repeat_words") / c("n_words"),
}
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def text_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), with `prefix`.

    Repeats are found per row: the sorted hashes and places of the 3-word
    windows put equal windows side by side, so the work is n log n in the words
    of one text and nothing is shuffled.  Within one text of n words, windows are
    compared by 64 - log2(n) bits of the hash of their three words.
    """
    names = {prefix + k for k in STATISTICS}
    first, rest, back = carried(docs, [c for c in docs.columns if c not in names])
    t = F.coalesce(docs[text], F.lit(""))
    a = hold(docs, first, _text=t, _w=words_of(t))
    n = F.size("_w")
    a = hold(
        a, rest, _n=n.cast("long"),
        _chars=F.length(F.array_join("_w", "")).cast("long"),
        _symbols=(F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long"),
        _lines=F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""),
        _h=F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(
            F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    # a window's hash gives its low bits to the window's place, so that plain longs are sorted
    bits = F.ceil(F.log2(F.greatest(F.col("_n"), F.lit(2)))).cast("int")
    a = hold(
        a.withColumn("_bits", bits), [*rest, "_n", "_chars", "_symbols", "_bits"],
        _dup=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _s=F.sort_array(F.transform("_h", lambda h, i: _left(_right(h, F.col("_bits")), F.col("_bits")).bitwiseOR(i))))

    def same(x, y):
        return _right(x.bitwiseXOR(y), F.col("_bits")) == 0

    twice = F.filter("_s", lambda x, i: same(x, F.get("_s", i - 1)) | same(x, F.get("_s", i + 1)))
    place = _left(F.lit(1).cast("long"), F.col("_bits")) - 1
    a = hold(a, [*rest, "_n", "_chars", "_symbols", "_dup"],
             _at=F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(place).cast("int"))))
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3)))),
        F.lit(0), lambda s, x: s + x)
    out = {"n_words": F.col("_n"), "word_chars": F.col("_chars"), "n_symbols": F.col("_symbols"),
           "n_dup_lines": F.col("_dup"), "n_repeat_words": covered.cast("long")}
    return hold(a, back, **{prefix + k: v for k, v in out.items()})


def base_failed(col=F.col) -> Column:
    return (col("n_words") < 50) | (100 * col("n_repeat_words") > 50 * col("n_words"))


def features(prefix: str = "") -> dict[str, Column]:
    def column(name):
        return F.col(prefix + name).cast("double")
    return {k: F.coalesce(F.try_divide(f(column), F.lit(1.0)) if k == "n_words" else
                          F.when(column("n_words") > 0, f(column)), F.lit(0.0)) for k, f in FEATURES.items()}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold): rows that fit are rejected."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self, feats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & ((feats[name] <= at) if op == "<=" else (feats[name] > at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {at:.6g}" for f, op, at in self.conditions)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Documents with a quality label, at most `max_rows` labels (those of the smallest
    hash of doc_id): (bad, part, f_*) where part 0 grows and 1 prunes.  The label side
    of the join has at most `max_rows` rows, so it is broadcast."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    one = one.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(one), F.col("doc_id") == F.col("_id"))
    rows = text_statistics(rows).where(~base_failed())
    return rows.select((F.col("_quality") == 0).cast("int").alias("bad"),
                       F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)).alias("part"),
                       *[v.alias(k) for k, v in features().items()])


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    if p == 0:
        return -1.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _precision(p: int, n: int) -> float:
    return (p + 1) / (p + n + 2)


def learn_rules(sample: DataFrame, n_bins: int = 32, max_rules: int = 8, max_conditions: int = 3,
                min_precision: float = 0.9, min_support: int = 8) -> list[Rule]:
    """Sequential covering over the bounded `sample` (see `labelled_sample`).

    Only class counts per (feature, bin) reach the driver: len(FEATURES) *
    (n_bins + 1) rows a step.  A rule must keep a Laplace precision of
    `min_precision` on the rows that did not grow it.
    """
    sample = cut(sample.repartition(4))  # after the scan of all documents, which keeps its own tasks
    names = list(FEATURES)
    marks = [(i + 1) / (n_bins + 1) for i in range(n_bins)]
    got = sample.agg(*[F.percentile(k, F.array(*map(F.lit, marks))).alias(k) for k in names]).first()
    cuts = {k: sorted(set(got[k] or [])) for k in names}
    feats = {k: F.col(k) for k in names}

    def bin_of(k):  # the number of cuts below the value: value > cuts[i] if bin > i
        edges = F.array(*[F.lit(float(x)) for x in cuts[k]]).cast("array<double>")
        return F.size(F.filter(edges, lambda e: F.col(k) > e))

    binned = cut(sample.select("bad", "part", *names, *[bin_of(k).alias(f"b_{k}") for k in names]))
    left, rules = F.lit(True), []

    def counts(where: Column) -> dict[str, dict[int, tuple[int, int]]]:
        table = binned.where(where).select("bad", F.explode(F.array(*[F.struct(
            F.lit(k).alias("k"), F.col(f"b_{k}").alias("b")) for k in names])).alias("x"))
        out: dict = {k: {} for k in names}
        for r in table.groupBy("x.k", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("all")).collect():
            out[r["k"]][r["b"]] = (r["p"], r["all"] - r["p"])
        return out

    while len(rules) < max_rules:
        conditions: list[tuple[str, str, float]] = []
        while len(conditions) < max_conditions:
            seen = counts(left & (F.col("part") > 0) & Rule(tuple(conditions)).column(feats))
            some = next(iter(seen.values()))
            p0, n0 = (sum(x[i] for x in some.values()) for i in (0, 1))
            if p0 < min_support or n0 == 0:
                break
            best = (0.0, None)
            for k in names:
                p, n = 0, 0
                for i, at in enumerate(cuts[k]):
                    p, n = p + seen[k].get(i, (0, 0))[0], n + seen[k].get(i, (0, 0))[1]
                    for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if a >= min_support:
                            best = max(best, (_gain(a, b, p0, n0), (k, op, at)), key=lambda x: x[0])
            if best[1] is None:
                break
            conditions.append(best[1])
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[: i + 1])) for i in range(len(conditions))]
        held = binned.where(left & (F.col("part") == 0)).agg(
            *[F.coalesce(F.sum(F.when(r.column(feats), F.col("bad"))), F.lit(0)).alias(f"p{i}") for i, r in enumerate(prefixes)],
            *[F.coalesce(F.sum(F.when(r.column(feats), 1 - F.col("bad"))), F.lit(0)).alias(f"n{i}") for i, r in enumerate(prefixes)]).first()
        score = [_precision(held[f"p{i}"], held[f"n{i}"]) for i in range(len(prefixes))]
        keep = max(range(len(prefixes)), key=lambda i: (score[i] >= min_precision, held[f"p{i}"] - held[f"n{i}"], -i))
        if score[keep] < min_precision:
            break
        rules.append(prefixes[keep])
        left = left & ~prefixes[keep].column(feats)
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The first rule that fits, as its text; null if none fits (the document is kept)."""
    feats, out = features(prefix), None
    for i, r in enumerate(rules):
        what = F.lit(f"{i + 1}: {r}")
        out = F.when(r.column(feats), what) if out is None else out.when(r.column(feats), what)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents with their statistics, base_failed, rule (string) and kept (boolean)."""
    rules = learn_rules(labelled_sample(docs, labels), **options)
    out = text_statistics(docs)
    out = out.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
