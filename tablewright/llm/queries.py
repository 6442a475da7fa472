"""The registered queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, clustering, html_extract, license_scan, line_dedup, mixing, quality_rules, simhash, spelling, substring_dedup,
               token_counts, topk, url_filter)
from .common import load, ship

#: The vocabulary file of the token queries.
VOCABULARY = "byte_bpe_50k.json"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels belong to the document whose number the url's path ends in."""
    key = url_filter.document_number(F.col("url"))
    out = url_filter.filter_urls(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"), key=key)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document for the target weights, at the input's token total."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out, domains = mixing.mix(docs, load(spark, sf_dir, "labels"))
    return out.select("_row.doc_id", F.col("_tokens").alias("n_tokens"), "rate", "copies",
                      *[F.get("_p", i).alias(f"p_{k}") for i, k in enumerate(domains)])


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(load(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    out = html_extract.extract(pages, html_extract.fit(pages, load(spark, sf_dir, "documents")), ["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "rule")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    out = token_counts.count_tokens(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id", "n_bytes"])
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustering.cluster(clustering.quantized(load(spark, sf_dir, "embeddings")), k=8, rounds=10, seed=3)
    return clustering.with_inertia(found, centroids)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(load(spark, sf_dir, "documents"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {name: _shipped(query) for name, query in dict(globals()).items() if name.startswith("op") and callable(query)}

_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

def _reputation_sql(rules, min_good: float, z: float) -> str:
    """The URL filter in SQL: hosts, level by level moments, posterior bounds, rules."""
    def tail(n):
        return f"array_to_string(string_split(host, '.')[-{n}:], '.')"

    def strength(groups):
        return f"""(SELECT round(1 / least(greatest((s - v) / w, 0.001), 0.999) - 1, 6) FROM (
            SELECT coalesce(sum(n * (k / n - m) ** 2), 0) AS s, sum(m * (1 - m)) AS v, nullif(sum(m * (1 - m) * (n - 1)), 0) AS w
            FROM {groups} WHERE n > 0))"""

    ends = " OR ".join(f"ends_with(host, '.{x}')" for x in url_filter.LONG_SUFFIXES)
    cases = [(h + p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')")
             for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    rule, verdict = (" ".join(f"WHEN {c} THEN '{x[i]}'" for *x, c in cases) for i in (0, 1))
    return f"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), {_UPPER}, {_LOWER}) AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        one AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
                WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
        c AS (SELECT host, CASE WHEN {ends} THEN {tail(3)} ELSE {tail(2)} END AS domain,
                     CASE WHEN {ends} THEN {tail(2)} ELSE {tail(1)} END AS suffix, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k
              FROM p LEFT JOIN one ON TRY_CAST(regexp_extract(path, '/([0-9]+)(?:\\.[^/]*)?/?$', 1) AS BIGINT) = doc_id GROUP BY host),
        s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 1) FROM c) AS m FROM c GROUP BY suffix),
        st0 AS (SELECT coalesce({strength("s0")}, 999) AS st),
        s1 AS (SELECT suffix, (k + st * m) / (n + st) AS m FROM s0, st0),
        d0 AS (SELECT c.suffix, domain, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM c JOIN s1 USING (suffix) GROUP BY c.suffix, domain),
        st1 AS (SELECT coalesce({strength("d0")}, 999) AS st),
        d1 AS (SELECT suffix, domain, (k + st * m) / (n + st) AS m FROM d0, st1),
        h0 AS (SELECT host, n, k, m FROM c JOIN d1 USING (suffix, domain)),
        st2 AS (SELECT coalesce({strength("h0")}, 999) AS st),
        b AS (SELECT host, k + st * m AS a, n - k + st * (1 - m) AS b FROM h0, st2),
        bad AS (SELECT host AS bad FROM b WHERE a / (a + b) + {z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) < {min_good})
        SELECT page_id, host, path, CASE {rule} END AS rule,
               CASE {verdict} WHEN bad IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM p LEFT JOIN bad ON host = bad"""




def _license_sql() -> str:
    """Phrases by place, and containment of every template in every block, all pairs."""
    def words(text):
        return [w.decode() for w in license_scan.words_of(text)]

    step = max(len(words(t)) for _, t in license_scan.TEMPLATES)
    rows = ", ".join(f"('{label}', {sorted(set(words(t)))})" for label, t in license_scan.TEMPLATES)
    phrases = ", ".join(f"('{label}', '{p}', {len(words(p))})" for p, label in license_scan.PHRASES.items())
    share = license_scan.THRESHOLD
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}),
                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p(label, phrase, n) AS (VALUES {phrases}),
        i AS (SELECT r, w, unnest(range(len(w))) AS place FROM d),
        base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
                 FROM i JOIN p ON array_to_string(w[place + 1:place + n], ' ') = phrase GROUP BY r),
        t(label, t) AS (VALUES {rows}),
        b AS (SELECT r, list_distinct(w[k * {step} + 1:(k + 2) * {step}]) AS b FROM (
                SELECT r, w, unnest(range((len(w) + {step} - 1) // {step})) AS k FROM d)),
        f AS (SELECT r, label, len(list_intersect(b, t)) / len(t) AS score FROM b JOIN t
                ON {share.denominator} * len(list_intersect(b, t)) >= {share.numerator} * len(t)),
        best AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM f GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.score, 0.0)::DOUBLE END AS score
        FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)"""


def _centroid_sql(k: int, rounds: int, seed: int, size: int = 64) -> str:
    """Lloyd's rounds, one after the other, over all distances."""
    def near(n):
        return f"""(SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, list_sum(list_transform(list_zip(k.v, m.v),
                    lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, m{n} m) GROUP BY r)"""

    steps = [f"""m{n + 1} AS MATERIALIZED (SELECT m.c, coalesce(s.v, m.v) AS v FROM m{n} m LEFT JOIN (
            SELECT c, list(v ORDER BY i) AS v FROM (
                SELECT best.c AS c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS v
                FROM {near(n)} JOIN (SELECT r, unnest(v) AS x, unnest(range({size})) AS i FROM k) USING (r) GROUP BY best.c, i) GROUP BY c) s USING (c))""" for n in range(rounds)]
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
        m0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1)::INTEGER AS c, v
            FROM (SELECT vec_id, v FROM k ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})),
        {", ".join(steps)},
        a AS (SELECT r, best.c AS cluster, best.d AS distance FROM {near(rounds)})
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
        FROM k JOIN a USING (r) JOIN m{rounds} m ON m.c = a.cluster"""


def _spelling_sql(least: int, factor: int) -> str:
    """Near words by what is left when each place is taken out; the crc32 byte by byte."""
    table = []
    for n in range(256):  # the table of the reversed polynomial, by its rule
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"""
        WITH RECURSIVE t AS (SELECT {table}::BIGINT[] AS t),
        d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
        c AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS h FROM d WHERE length(run) >= {least} GROUP BY doc_id, run),
        s AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                  lambda crc, b: xor(crc >> 8, t[xor(crc & 255, b) + 1])), 4294967295) AS crc FROM c, t),
        o AS (SELECT CASE WHEN crc % 31 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM s),
        v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= 2),
        x AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
        e AS (SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT v.word, v.n, x.word, x.n FROM v JOIN x ON v.word = x.rest
              UNION SELECT x.word, x.n, v.word, v.n FROM v JOIN x ON v.word = x.rest),
        b AS MATERIALIZED (SELECT word, n, count(*) AS n_near, min({{'m': -near_n, 'w': near}}) AS best FROM e GROUP BY word, n),
        f AS MATERIALIZED (SELECT word, n_near, CASE WHEN -best.m >= {factor} * n THEN best.w END AS form, CASE WHEN -best.m >= {factor} * n THEN -best.m END AS form_n FROM b),
        r AS (SELECT word, form AS root, 1 AS hop FROM f WHERE form IS NOT NULL
              UNION ALL SELECT r.word, f.form, hop + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
        z AS (SELECT word, arg_max(root, hop) AS root FROM r GROUP BY word)
        SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
        FROM v LEFT JOIN f ON v.word = f.word LEFT JOIN z ON v.word = z.word"""


ORACLE: dict[str, str] = {
    "op11_license_scan": _license_sql(),
    "op12_centroids": _centroid_sql(k=8, rounds=10, seed=3),
    "op13_spelling": _spelling_sql(spelling.LEAST, spelling.FACTOR),
    "op1_url_filter": _reputation_sql(url_filter.RULES, min_good=0.5, z=1.645),
    "op2_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                          lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
        x AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM s),
        f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
        g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (
                SELECT x.doc_id, unnest(range(x.i + 1, x.i + 51)) AS j FROM x JOIN f USING (h) WHERE x.doc_id > f.least) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(
                   list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]), ' ') END) AS kept_sha256
        FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS t FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS (SELECT vec_id, unnest(t) AS w, unnest(range(len(t))) AS k FROM v),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score FROM e q JOIN e c ON q.k = c.k
              WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
        k AS (SELECT doc_id, line, i, translate(trim(line, {_WHITE}), {_UPPER}, {_LOWER}) AS key FROM x),
        f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, k.line, k.i, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
}
