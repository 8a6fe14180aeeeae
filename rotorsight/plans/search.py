"""Two-stage retrieval for any number of cases in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import limits as L
from ..operators import retrieval as R
from ..session import materialise


@dataclass(frozen=True)
class Result:
    queries: DataFrame
    recalled: DataFrame       # every candidate with its cosine and rank
    reports: DataFrame        # per query, on the cosine
    kept: DataFrame           # candidates of accepted queries after reranking
    rerank_reports: DataFrame
    merged: DataFrame         # one row per case and chunk
    dropped: DataFrame        # queries beyond the bound that was asked for


def retrieve(chunks: DataFrame, queries: DataFrame, scorer=None, k: int | None = None,
             recall_k: int | None = None, id_type: str = "long",
             details: DataFrame | None = None, max_queries: int | None = None) -> Result:
    """Recall, gate, rerank, merge. ``scorer(hits)`` returns the second score as a column.

    ``scorer`` reads the query columns and every chunk column; without one the order of the
    cosine stands. Candidates are a few rows per query and are written first, so the planner
    knows their size when it joins vectors and (from ``details``, keyed by ``chunk_id``) source
    and text. A candidate without details stays, with nulls. ``max_queries`` bounds the queries
    per case; those left out are in ``dropped``.
    """
    k = R.checked_k(k, L.DEFAULT_TOP_K_PER_QUERY)
    recall_k = R.checked_recall(recall_k, k, scorer is not None)
    asked = materialise(R.distinct_queries(queries, max_queries))
    found = materialise(R.top_k(chunks, asked, recall_k, id_type))
    vectors = asked.select("case_id", "query_pos", "query_vec")
    hits = found.join(chunks, "chunk_id").join(vectors, ["case_id", "query_pos"])
    if details is not None:
        wanted = details.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
        hits = hits.join(wanted, "chunk_id", "left")
    recalled = materialise(hits)
    reports = R.reports(recalled, asked)
    accepted = R.gate(recalled, reports)
    order = scorer(accepted) if scorer is not None else F.col("score")
    kept = R.rerank(accepted, order, k).drop("query_vec", "embedding")
    rerank_reports = R.reports(kept, asked, "rerank_score", "rerank_rank") \
        .filter("returned > 0")
    return Result(asked, recalled, reports, kept, rerank_reports,
                  R.merge_hits(kept, "rerank_score"), R.dropped_queries(queries, asked))


def merge_rounds(first: Result, second: Result) -> DataFrame:
    """Union of two rounds under the same rule; earlier round wins ties."""
    both = first.kept.withColumn("round", F.lit(1)).unionByName(
        second.kept.withColumn("round", F.lit(2)))
    return R.merge_hits(both, "rerank_score")
