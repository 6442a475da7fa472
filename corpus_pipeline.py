"""A training corpus from raw documents: five stages, each one operator of the library.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents.  All but the last return
the columns of `documents`.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, line_dedup, mixing, quality_rules, simhash
from tablewright.llm.common import load, ship
from tablewright.session import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    ship(spark)
    labels = load(spark, sf_dir, "labels")
    rules = quality_rules.learn_rules(quality_rules.labelled_sample(docs, labels))
    out = quality_rules.text_statistics(docs, prefix="_q_")
    failed = quality_rules.base_failed(lambda c: F.col("_q_" + c))
    return out.where(~failed & quality_rules.verdict(rules, prefix="_q_").isNull()).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in five documents or more stay in the largest doc_id only."""
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else out[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates; rows go by
    doc_id and text, and of rows equal in both one stays.  Rows without doc_id take no part."""
    ship(spark)
    gone, repeated = simhash.copies(docs, shingle=4, distance=4)
    row = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))

    def keyed(names):
        names = names.select(F.col("doc_id").alias("_copy"), F.col("row").alias("_row"))
        return names, (docs["doc_id"].cast("long") == names["_copy"]) & (row == names["_row"])

    once = docs.join(*keyed(gone.unionByName(repeated)), "left_anti")
    first = docs.join(*keyed(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(first).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate asks for; no rate is below one, so that
    the mixture is reached by repeating and no clean document goes."""
    ship(spark)
    out, _ = mixing.mix(docs, load(spark, sf_dir, "labels"), total="cover", min_rate=1.0)
    return out.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded documents and of their decoded texts."""
    ship(spark)
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
          ("mixing to target weights", mixture), ("BPE encoding and decoding", encode)]

#: The learned rules, XXH64 and the vocabulary are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the session's shared checkpoint folder."""
    docs = load(spark, sf_dir, "documents")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        path = f"{root}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
