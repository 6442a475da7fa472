"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight), a term being a dimension.  Rows and
queries are dealt into blocks; one task holds one block of rows as postings by
term, and takes each query of one block of queries in turn: every term of the
query scatters weight times posting weights into a dense array of scores.  The k
best of the block leave the task and meet in a ranked merge.  Work is split into
(rows / block_rows) x (queries / block_queries) equal tasks; nothing is
broadcast or gathered.

Defined results: rows with a null id, a null vector, or a null or non-finite
component take no part; vectors may differ in length (a missing component is
zero); repeated candidate rows are each ranked; repeated equal queries are one;
rows with the query's own id are not its candidates.  Scores beyond 64 bits
saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_groups


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of every component as long, x taken as double."""
    x = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    limit = float(1 << 62)
    return vectors.where(ok).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.greatest(
        F.least(F.floor(v * scale).cast("double"), F.lit(limit)), F.lit(-limit)).cast("long")).alias("terms"))


def _postings(table: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """(ids, {term: (rows, weights)}, largest sum of |weights| of a row), rows by ascending id."""
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = table.column("terms").combine_chunks()
    n = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    term = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    row = np.empty(len(ids), np.int64)
    row[order] = np.arange(len(ids))
    row = np.repeat(row, n)
    some = flat != 0
    term, row, flat = term[some], row[some], flat[some]
    by = np.lexsort((row, term))
    term, row, flat = term[by], row[by], flat[by]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    parts = {int(term[a]): (row[a:b], flat[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(term)], strict=True)}
    return ids[order], parts, max((int(np.abs(w.astype(object)).max()) for _, w in parts.values()), default=0)


def search_block(rows: pa.Table, queries: pa.Table, k: int) -> dict[str, list]:
    """The k best rows of the block for each query: score descending, then vec_id."""
    ids, postings, top = _postings(rows)
    out: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
    for q, key, terms in zip(queries.column("vec_id").to_pylist(), queries.column("query").to_pylist(), queries.column("terms").to_pylist(), strict=True):
        wide = sum(abs(w) for w in terms) * top >= 1 << 63  # beyond 64 bits: Python's integers
        score = np.zeros(len(ids), object if wide else np.int64)
        for term, w in enumerate(terms):
            if w and term in postings:
                at, weights = postings[term]
                score[at] += w * (weights.astype(object) if wide else weights)
        own = slice(*np.searchsorted(ids, [q, q + 1]).tolist())
        mine = np.concatenate((score[:own.start], score[own.stop:]))
        left = np.concatenate((ids[:own.start], ids[own.stop:]))
        if len(mine) > k:
            if wide:
                best = np.array(sorted(range(len(mine)), key=lambda i: (-mine[i], i))[:k])
            else:
                edge = np.partition(mine, len(mine) - k)[len(mine) - k]
                over, tied = np.flatnonzero(mine > edge), np.flatnonzero(mine == edge)
                best = np.concatenate((over, tied[:k - len(over)]))  # rows go by id: the first ties win
            mine, left = mine[best], left[best]
        out["query_id"] += [q] * len(left)
        out["query"] += [key] * len(left)
        out["vec_id"] += left.tolist()
        out["score"] += [max(min(int(s), (1 << 63) - 1), -(1 << 63)) for s in mine]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 4096, block_queries: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of highest inner product for each query.

    Both inputs are (vec_id, terms) as `quantized` gives them."""
    vectors, queries = cut(vectors), cut(queries.distinct())
    n_rows = max(1, -(-vectors.count() // block_rows))
    n_queries = max(1, -(-queries.count() // block_queries))
    key = F.xxhash64("vec_id", "terms")

    def to_each(n, name):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    a = vectors.select("vec_id", "terms", F.lit(0).cast("long").alias("query"), F.lit(False).alias("asks"),
                       F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int").alias("i"), to_each(n_queries, "j"))
    b = queries.select("vec_id", "terms", key.alias("query"), F.lit(True).alias("asks"),
                       to_each(n_rows, "i"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_queries)).cast("int").alias("j"))

    def run(batches):
        for table, group in whole_groups(batches, ["i", "j"], rows=1):
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
            for x, y in zip(starts, [*starts[1:], len(group)], strict=True):
                block = table.slice(x, y - x)
                asks = block.column("asks")
                out = search_block(block.filter(pa.compute.invert(asks)), block.filter(asks), k)
                yield pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))

    cells = a.union(b.select(a.columns)).repartition("i", "j").sortWithinPartitions("i", "j")
    found = cells.mapInArrow(run, "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
