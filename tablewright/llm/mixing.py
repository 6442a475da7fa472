"""Mixing to target weights with soft domain membership.

A naive-Bayes classifier, fitted on a bounded sample of labelled documents dealt out
by domain, gives every document a posterior over the domains.  With t tokens and
posterior p a document adds t * p[k] tokens to domain k; projected-gradient least
squares finds rates x >= `min_rate` (0 unless asked otherwise) for which the expected
totals sum(x * t * p[k]) match weight[k] * total.  The residual r is whitened by the
domains' Gram matrix W; from x = `start` every iteration is x <- max(min_rate, x - p . s),
with s a multiple of W r (the gradient) or of r scaled by the Gram matrix of the rows
above the bound, whichever length along these two arcs leaves least.  One job tries the
lengths of an iteration; the fit ends where targets are met, where the projected
gradient gains nothing any more, or after `max_steps`.  A document's gradient depends
on its posterior alone, so documents of equal posterior (three decimals) are summed
first, and the driver sees a few sums per length tried and the list of the steps s: a
rate is those steps replayed from `start`.

Defined results: null text has no tokens and the prior as its posterior; labels
that are null or have no document are ignored; a domain with under `min_labels`
labelled documents, or without tokens, is left out and the other weights are
scaled up; with fewer than two domains every rate is total / tokens; repeated
rows each have their rate, and are rounded alike (a row without doc_id by its text);
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut, hold, literal_doubles, words_of

#: Domain of a label row, in order; the first that fits holds.
DOMAINS = {"toxic": "toxic = 1", "poor": "quality = 0", "good": "quality = 1"}
TARGETS = {"good": 0.85, "poor": 0.07, "toxic": 0.08}
#: Scales of the summed log odds (factor, power of the number of distinct words) tried on held-out rows.
SCALES = [(a, p) for p in (0.0, 0.5) for a in (0.03, 0.1, 0.3, 1.0, 3.0)]


def buckets_of(words: Column, n_buckets: int) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n_buckets)).cast("int")))


def tokens_and_buckets(docs: DataFrame, keep: list[Column], n_buckets: int) -> DataFrame:
    """`keep`, the number of words and the distinct hash buckets of the words."""
    a = hold(docs, keep, _w=words_of(F.col("text")))
    names = [c for c in a.columns if c != "_w"]
    return hold(a, names, _tokens=F.size("_w").cast("long"), _buckets=buckets_of(F.col("_w"), n_buckets))


@dataclass(frozen=True)
class Classifier:
    """Log odds of each domain against the first: prior, and weight of each bucket."""

    domains: list[str]
    prior: list[float]
    weights: list[list[float]]
    scale: tuple[float, float] = (1.0, 0.0)

    @property
    def n_buckets(self) -> int:
        return len(self.weights[0]) if self.weights else 1

    def sums(self) -> list[Column]:
        """Summed log odds of each further domain, over the document's buckets."""
        def summed(weights):
            return F.aggregate("_buckets", F.lit(0.0), lambda s, b: s + F.get(literal_doubles(weights), b))

        return [summed(w) for w in self.weights]

    def posterior(self, sums: list[Column], scale: tuple[float, float]) -> list[Column]:
        n = F.greatest(F.size("_buckets"), F.lit(1))
        odds = [F.exp(F.greatest(F.least(F.lit(p) + scale[0] * s / F.pow(n, F.lit(scale[1])), F.lit(30.0)), F.lit(-30.0)))
                for p, s in zip(self.prior, sums, strict=True)]
        total = sum(odds, F.lit(1.0))
        return [F.lit(1.0) / total, *[o / total for o in odds]]


def _quotas(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """`rows` dealt to the domains: small ones whole, what they leave equally to the others."""
    out = {}
    for n, k in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[k] = min(sizes[k], (rows - sum(out.values())) // (len(sizes) - n))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, domains: dict[str, str], max_rows: int, n_buckets: int) -> DataFrame:
    """(domain, part, share, _buckets) of at most `max_rows` labelled documents, those of the
    smallest hash of doc_id in each domain; `share` is the part of the domain's labels taken.
    The label side of the join has at most that many rows and is broadcast."""
    of = F.coalesce(*[F.when(F.expr(c), F.lit(k)) for k, c in domains.items()])
    one = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), of.alias("domain"))
    one = cut(one.where("domain is not null").groupBy("_id").agg(F.max("domain").alias("domain")))
    sizes = {r["domain"]: r["count"] for r in one.groupBy("domain").count().collect()}
    parts = [one.where(F.col("domain") == k).orderBy(F.xxhash64("_id"), "_id").limit(n).withColumn("share", F.lit(n / sizes[k]))
             for k, n in _quotas(sizes, max_rows).items()]
    one = reduce(DataFrame.unionAll, parts, one.limit(0).withColumn("share", F.lit(1.0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(one), F.col("doc_id") == F.col("_id"))
    rows = tokens_and_buckets(rows, ["domain", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(4)).alias("part"), "share"], n_buckets)
    return rows.select("domain", "part", "share", "_buckets")


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, max_rows: int = 20_000,
                   n_buckets: int = 4096, min_labels: int = 20) -> Classifier:
    """Naive Bayes on the distinct words of the sample; a quarter of it picks the scale.
    Priors and losses count a row 1 / share times, as if no label had been left out.

    The driver gets the counts per bucket and domain: n_buckets rows."""
    sample = cut(labelled_sample(docs, labels, domains or DOMAINS, max_rows, n_buckets).repartition(8))
    train = sample.where("part > 0")
    seen = train.groupBy("domain").agg(F.count("*").alias("n"), F.sum(1 / F.col("share")).alias("all")).collect()
    size = {r["domain"]: r["all"] for r in seen if r["n"] >= min_labels}
    names = sorted(size, key=lambda k: (-size[k], k))
    if len(names) < 2:
        return Classifier(names or ["all"], [], [])
    counts = train.select("domain", F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{i}") for i, k in enumerate(names)])
    table = {r["bucket"]: r for r in counts.collect()}
    total = [sum(r[f"n{i}"] for r in table.values()) + n_buckets for i in range(len(names))]

    def weight(i, b):
        mine, first = (table[b][f"n{j}"] + 1 if b in table else 1 for j in (i, 0))
        return round(math.log(mine / total[i]) - math.log(first / total[0]), 6)

    weights = [[weight(i, b) for b in range(n_buckets)] for i in range(1, len(names))]
    model = Classifier(names, [round(math.log(size[k] / size[names[0]]), 6) for k in names[1:]], weights)
    held = hold(sample.where((F.col("part") == 0) & F.col("domain").isin(names)), ["domain", "share", "_buckets"],
                **{f"_s{i}": s for i, s in enumerate(model.sums())})
    sums = [F.col(f"_s{i}") for i in range(len(weights))]
    losses = []
    for scale in SCALES:
        p = model.posterior(sums, scale)
        own = F.coalesce(*[F.when(F.col("domain") == k, x) for k, x in zip(names, p, strict=True)])
        losses.append(F.sum(-F.log(F.greatest(own, F.lit(1e-12))) / F.col("share")))
    loss = held.agg(*[x.alias(f"l{i}") for i, x in enumerate(losses)]).first()
    best = min(range(len(SCALES)), key=lambda i: (loss[i] if loss[i] is not None else 0.0, i))
    return Classifier(names, model.prior, weights, SCALES[best])


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """The documents as a struct `_row`, `_tokens`, and `_p`: the posterior, to three decimals."""
    first, rest, back = carried(docs, docs.columns)
    a = tokens_and_buckets(docs, first, model.n_buckets)
    a = hold(a, [*rest, "_tokens", "_buckets"], **{f"_s{i}": s for i, s in enumerate(model.sums())}) if model.weights else a
    p = model.posterior([F.col(f"_s{i}") for i in range(len(model.weights))], model.scale)
    others = [F.round(x, 3) for x in p[1:]]
    main = F.greatest(F.round(F.lit(1.0) - sum(others, F.lit(0.0)), 3), F.lit(0.0))
    a = hold(a, [*rest, "_tokens"], _p=F.array(main, *others))
    return a.select(F.struct(*back).alias("_row"), "_tokens", "_p")


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """Gaussian elimination with pivots."""
    n = len(v)
    a = [[*m[i], v[i]] for i in range(n)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(i + 1, n):
            f = a[r][i] / a[i][i]
            a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (a[i][n] - sum(a[i][j] * out[j] for j in range(i + 1, n))) / a[i][i]
    return out


def _dot(x: list[float], y: list[float]) -> float:
    return sum(a * b for a, b in zip(x, y, strict=True))


def _literal_rows(rows: list[list[float]]) -> Column:
    """A constant array<array<double>>, parsed from one text."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in r) + ")" for r in rows) + ")")


@dataclass(frozen=True)
class Rates:
    """A rate is `start` after the projected steps: each takes posterior . step off, down to `min_rate` at most."""

    start: float
    steps: list[list[float]]
    min_rate: float

    def column(self, p: Column) -> Column:
        if not self.steps:
            return F.lit(float(self.start))
        return F.aggregate(_literal_rows(self.steps), F.lit(float(self.start)), lambda x, s: F.greatest(
            x - sum((F.get(p, k) * F.get(s, k) for k in range(len(self.steps[0]))), F.lit(0.0)), F.lit(float(self.min_rate))))


#: Ridges of the scaled direction, and the lengths tried along it and along the gradient.
RIDGES = (1e-8, 1e-4, 1e-2)
SCALED_LENGTHS = [2.0 ** e for e in range(2, -10, -1)]
GRADIENT_LENGTHS = [2.0 ** e for e in range(0, 14, 2)]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | str | None = None,
              min_rate: float = 0.0, max_steps: int = 100, tolerance: float = 1e-6) -> Rates:
    """Rates for `members` (_tokens, _p).  `total`: the token total to reach; None: as many as
    there are; "cover": the least total at which no domain has more tokens than its target."""
    table = members.groupBy("_p").agg(F.sum("_tokens").cast("double").alias("_t"))
    table = cut(table.where("_t > 0"))
    k = len(domains)
    p = [F.get("_p", i) for i in range(k)]
    row = table.agg(*[F.sum(F.col("_t") * p[i]).alias(f"s{i}") for i in range(k)]).first()
    now = [row[i] or 0.0 for i in range(k)]
    use = [i for i in range(k) if now[i] > 1e-9 * max(sum(now), 1.0) and targets.get(domains[i], 0.0) > 0]
    if not use:
        return Rates(1.0, [], min_rate)
    scale = sum(targets[domains[i]] for i in use)
    weight = [targets[domains[i]] / scale if i in use else 0.0 for i in range(k)]
    goal = sum(now) if total is None else max(now[i] / weight[i] for i in use) if total == "cover" else float(total)
    if k < 2:
        return Rates(max(goal / now[0], min_rate), [], min_rate)
    start = max(1.0, min_rate)

    def after(taken, steps):
        """(residual, squared way, Gram matrix of the rows above the bound) where each of `steps` leads from `taken`."""
        rows = table.select("_t", "_p", Rates(start, taken, min_rate).column(F.col("_p")).alias("_x"))
        rows = rows.select("_t", "_p", "_x", F.posexplode(_literal_rows(steps)).alias("j", "_s"))
        x = F.greatest(F.col("_x") - sum((p[i] * F.get("_s", i) for i in use), F.lit(0.0)), F.lit(float(min_rate)))
        rows = rows.select("_t", "_p", "_x", "j", x.alias("_y"))
        free = F.when(F.col("_y") > min_rate, F.col("_t")).otherwise(0.0)
        got = rows.groupBy("j").agg(
            F.sum(F.col("_t") * (F.col("_y") - F.col("_x")) ** 2).alias("way"),
            *[F.sum(F.col("_t") * F.col("_y") * p[i]).alias(f"s{i}") for i in use],
            *[F.sum(free * p[a] * p[b]).alias(f"g{a}_{b}") for a in use for b in use]).collect()
        return [([r[f"s{i}"] - weight[i] * goal for i in use], r["way"], [[r[f"g{a}_{b}"] for b in use] for a in use])
                for r in sorted(got, key=lambda r: r["j"])]

    def whole(step):
        placed = dict(zip(use, step, strict=True))
        return [placed.get(i, 0.0) for i in range(k)]

    all_rows = table.agg(*[F.sum(F.col("_t") * p[a] * p[b]).alias(f"g{a}_{b}") for a in use for b in use]).first()
    # a small ridge, in each domain's own measure, keeps domains that hardly differ from blowing up
    white = [[all_rows[f"g{a}_{b}"] * (1.001 if a == b else 1.0) for b in use] for a in use]
    taken = []
    off, _, above = after(taken, [[0.0] * k])[0]
    for _ in range(max_steps):
        if all(abs(x) <= tolerance * weight[i] * goal for i, x in zip(use, off, strict=True)):
            break
        slope = _solve(white, off)
        scaled = [_solve([[x + ridge * y for x, y in zip(a, w, strict=True)] for a, w in zip(above, white, strict=True)], off) for ridge in RIDGES]
        tried = [[a * x for x in slope] for a in GRADIENT_LENGTHS] + [[a * x for x in s] for s in scaled for a in SCALED_LENGTHS]
        tried = [whole(s) for s in tried]
        found = after(taken, tried)
        squares = [_dot(f[0], _solve(white, f[0])) for f in found]
        best = min(range(len(tried)), key=lambda j: squares[j])
        left = _dot(off, slope)
        if not squares[best] < left:  # as low as doubles can tell
            break
        taken.append(tried[best])
        off, _, above = found[best]
        if found[0][1] <= 1e-10 * left:  # the way of the plain gradient step is the projected gradient
            break
    return Rates(start, taken, min_rate)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | str | None = None,
        min_rate: float = 0.0, **options) -> tuple[DataFrame, list[str]]:
    """(`_row`, `_tokens`, `_p`, rate, copies) of the documents, and the domains of `_p`.

    copies is the rate rounded up or down by a hash of doc_id (of the text where that is null),
    so that its mean is the rate."""
    model = fit_classifier(docs, labels, **options)
    members = memberships(docs, model)
    rates = fit_rates(members, model.domains, targets or TARGETS, total, min_rate)
    out = members.withColumn("rate", F.round(rates.column(F.col("_p")), 9))
    row = F.col("_row")
    drawn = F.when(row["doc_id"].isNotNull(), F.xxhash64(row["doc_id"], F.lit(2))).otherwise(F.xxhash64(row["text"], F.lit(2)))
    chance = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", F.floor(F.col("rate") + chance).cast("int")), model.domains
