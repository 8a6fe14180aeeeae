"""Inverted lists: recall against the exact path, exhaustive probing, copies, odd rows."""

import math

import numpy as np
import pytest

from rotorsight.operators import retrieval as Q, vector_index as V


def unit(rng, n, width=24, groups=30):
    middle = rng.normal(size=(groups, width))
    x = middle[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def tables(spark, vectors, every=40):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i % 7, i, f"q{i}", [float(x) for x in v])
                                     for i, v in rows if i % every == 0],
                                    "case_id long, query_pos long, query_text string, query_vec array<double>")
    return chunks, queries


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    chunks, queries = tables(spark, unit(np.random.default_rng(1), 4000))
    index = V.build(chunks, str(tmp_path_factory.mktemp("index") / "a"), 32)
    return chunks, queries, index, Q.top_k(chunks, queries, 10).cache()


def rows(found):
    return sorted((r.case_id, r.query_pos, r["rank"], r.chunk_id, round(r.score, 8))
                  for r in found.collect())


def test_every_row_is_in_one_list(some):
    chunks, _, index, _ = some
    held = index.lists().collect()
    assert sorted(r.chunk_id for r in held) == list(range(4000))
    for r in held[::50]:
        again = index.centroids[r.list_id] + r.scale * np.frombuffer(r.code, np.int8)
        assert np.abs(again - np.array(r.embedding)).max() <= r.scale / 2 + 1e-6


def test_all_lists_give_the_exact_result(some):
    _, queries, index, exact = some
    assert rows(V.search(index, queries, 10, 32)) == rows(exact)


def test_recall_with_few_lists(some, spark):
    chunks, queries, index, exact = some
    n_probe = V.enough_probes(index, chunks, queries, 10)
    assert n_probe <= 8
    found = V.search(V.load(spark, index.path), queries, 10, n_probe)
    assert V.recall(found, exact) >= 0.9


def test_only_probed_lists_are_read(some):
    _, queries, index, _ = some
    one = queries.filter("query_pos = 0")
    plan = V.search(index, one, 10, 2)._jdf.queryExecution().executedPlan().toString()
    scans = [p for p in plan.split("FileScan parquet")[1:] if "list_id" in p]
    assert scans and all("PartitionFilters: [list_id" in s.split("PushedFilters")[0] for s in scans)
    read = {r.list_id for r in index.lists(V._nearest(
        np.array([one.first().query_vec]), index.centroids, 2)[0]).select("list_id").collect()}
    assert len(read) == 2


def test_blocks_give_the_same(some):
    _, queries, index, _ = some
    few = queries.filter("query_pos < 1000")
    assert rows(V.search(index, few, 5, 4, block_bytes=1)) == rows(V.search(index, few, 5, 4))


def test_copies_ties_and_odd_rows(spark, tmp_path):
    vectors = unit(np.random.default_rng(2), 300)
    vectors[100:200] = vectors[0]
    chunks, queries = tables(spark, vectors, 100)
    odd = spark.createDataFrame([(900, None), (901, []), (902, [math.nan] * 24), (903, [None] * 24)],
                                "chunk_id long, embedding array<float>")
    index = V.build(chunks.union(odd), str(tmp_path / "b"), 8)
    assert rows(V.search(index, queries, 20, 8)) == rows(Q.top_k(chunks, queries, 20))


def test_empty_tables(spark, tmp_path):
    chunks, queries = tables(spark, unit(np.random.default_rng(3), 50), 10)
    empty = V.build(chunks.limit(0), str(tmp_path / "c"), 8)
    assert V.search(empty, queries, 5, 2).count() == 0
    index = V.build(chunks, str(tmp_path / "d"), 200)         # fewer rows than lists
    assert V.search(index, queries.limit(0), 5, 2).count() == 0
    assert rows(V.search(index, queries, 3, 200)) == rows(Q.top_k(chunks, queries, 3))


def test_sample_bound(spark):
    chunks, _ = tables(spark, unit(np.random.default_rng(4), 1000))
    assert V.fit(chunks, 10, sample_bytes=4 * 24 * 50).shape == (10, 24)


def test_registered_search_reaches_the_recall(spark):
    """The registered query's index against brute force on the given vectors."""
    from rotorsight.plans.registry import QUERIES
    for sf in ("0.01", "0.1"):
        folder = f"/root/testdata/sf{sf}"
        vectors = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
        ids = np.array([r.vec_id for r in vectors])
        x = np.array([r.embedding for r in vectors], dtype=np.float64)
        got = {}
        for r in QUERIES["indexed_top_k"](spark, folder).collect():
            got.setdefault(r.query_pos, set()).add(r.chunk_id)
        hits = []
        for q in np.nonzero(ids % 100 == 0)[0]:
            best = np.lexsort((ids, -np.round(x @ x[q], 9)))[:15]
            hits.append(len(got[ids[q]] & set(ids[best].tolist())) / 15)
        assert len(hits) == len(got) and np.mean(hits) >= 0.9
