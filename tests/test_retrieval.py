"""Exact top-k against brute force, and the query clean-up rules."""

import numpy as np
import pytest

from rotorsight.operators import retrieval as R
from rotorsight.plans import search


def vectors(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 8))
    v[n // 2] = v[0]                       # equal scores: the smaller id must win
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block_bytes", [R.QUERY_BLOCK_BYTES, 100, 1])
def test_top_k_is_exact_for_any_block(spark, block_bytes):
    chunk_vecs, query_vecs = vectors(90, 1), vectors(7, 2)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(chunk_vecs)],
                                   "chunk_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(1, i, f"q{i}", v.tolist()) for i, v in enumerate(query_vecs)],
                                    "case_id long, query_pos long, query_text string, "
                                    "query_vec array<double>")
    got = {(r.query_pos, r["rank"]): r.chunk_id
           for r in R.top_k(chunks, queries, 6, block_bytes=block_bytes).collect()}
    for q, v in enumerate(query_vecs):
        scores = np.round(chunk_vecs @ v, R.SCORE_DIGITS)
        order = sorted(range(90), key=lambda i: (-scores[i], i))[:6]
        assert [got[q, r] for r in range(6)] == order


def test_gate_merge_and_limits(spark):
    unit = lambda *x: (np.array(x) / np.linalg.norm(x)).tolist()
    chunks = spark.createDataFrame(
        [(1, unit(1, 0), "a/x.md", "轴承 温度"), (2, unit(1, .1), "a/y.md", "轴承"),
         (3, unit(-1, .2), "b/z.md", "other")],
        "chunk_id long, embedding array<double>, source string, text string")
    queries = spark.createDataFrame(
        [(7, 0, "轴承 温度", unit(1, .05)), (7, 1, " 轴承 温度 ", unit(1, .05)),
         (7, 2, "nothing", unit(0, -1)), (7, 3, "  ", unit(0, 1))],
        "case_id long, query_pos long, query_text string, query_vec array<double>")
    found = search.retrieve(chunks, queries, lambda h: R.term_overlap("query_text", "text"), k=1)
    assert found.queries.count() == 2
    reports = {r.query_pos: r for r in found.reports.collect()}
    assert not reports[0].low_confidence and reports[2].low_confidence
    assert reports[0].distinct_sources == 3
    best = found.merged.collect()
    assert [(r.chunk_id, r.hit_by, r.rerank_score) for r in best] == [(1, "轴承 温度", 1.0)]
    rules = R.sufficiency_rules(found.queries.select("case_id").distinct(), found.merged,
                                found.reports).first()
    assert rules.rules == ["majority_refused"]
    assert R.checked_k(1) == 1 and R.checked_k(20) == 20 and R.checked_k(None) == 5
    assert R.checked_recall(None, 3, True) == 15 and R.checked_recall(None, 3, False) == 3
    assert R.checked_recall(50, 3, True) == 50


def test_clean_queries_and_fallback(spark):
    proposed = spark.createDataFrame(
        [(1, 0, "轴承温度？"), (1, 1, " 轴承 温度。"), (1, 2, "振动"), (1, 3, None), (1, 4, "振动!"),
         (2, 0, "原话。")], "case_id long, query_pos long, query_text string")
    asked = spark.createDataFrame([(1, "报警"), (2, "原话"), (3, "无")],
                                  "case_id long, query_text string")
    done = R.with_fallback(asked, R.clean_queries(proposed, asked, 4)).collect()
    assert sorted((r.case_id, r.n, r.query_text, r.degraded) for r in done) == [
        (1, 1, "轴承温度？", False), (1, 2, "振动", False), (2, 1, "原话", True), (3, 1, "无", True)]
