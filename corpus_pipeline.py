"""A training corpus from raw documents: filter, deduplicate, decontaminate, tokenise.

``STAGES`` are applied in order; every stage sees all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rotorsight.llm import bpe, decontaminate, exact_dedup, quality, simhash
from rotorsight.llm.common import prepare, shared_dir
from rotorsight.llm.queries import quality_model, table, tokenizer


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half stay.

    Rows are written with their statistics, which are the dear part, so these are computed once.
    """
    prepare(spark)
    rows, model = quality_model(spark, sf_dir, docs, F.struct(*docs.columns).alias("row"))
    return rows.filter(quality.score_of_stats(model) >= 0.5).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts one stays: the longest, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked SimHash fingerprints one document stays: the smallest doc_id."""
    prepare(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window stay."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its bytes again."""
    prepare(spark)
    ranks, pattern = tokenizer()
    decoded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    body_hash = F.xxhash64(F.col("body").cast("string"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          (body_hash == F.col("k2")).alias("round_trip"))


STAGES = [("quality", filter_quality), ("exact_dedup", drop_exact_copies),
          ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated),
          ("tokens", tokenise)]

#: The classifier and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
