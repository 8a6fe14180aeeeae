"""An inverted-list index over chunk vectors: coarse centroids, residual codes, exact re-score.

``top_k`` in ``retrieval`` stays the exact default. Here every vector belongs to the list of its
nearest centroid and carries the difference to it as one byte per dimension. A search reads only
the lists next to its queries, and of those the codes only; the few best candidates per query are
then scored with their full vectors. Lists are folders, so a search names the ones it needs as a
partition filter, and neither the vectors nor the codes are ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .retrieval import SCORE_DIGITS, _query_blocks, cosine, top_k

#: The centroids are fitted on a sample of at most so many bytes of vectors; every row is indexed.
SAMPLE_BYTES = 64 << 20
ROUNDS = 12
#: Bytes of query vectors that are sent to the tasks at once; candidates per result row.
BLOCK_BYTES = 4 << 20
REFINE = 8
#: Queries that the recall is measured with when the number of probes is chosen.
SAMPLE_QUERIES = 64


@dataclass(frozen=True)
class Index:
    """Where the lists are, the schema of their rows, and the centroid of each list."""

    spark: SparkSession
    path: str
    schema: str
    centroids: np.ndarray

    def lists(self, wanted=None) -> DataFrame:
        """Rows (chunk_id, scale, code, embedding, list_id); of the wanted lists only."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")
        return rows if wanted is None else rows.filter(F.col("list_id").isin([int(i) for i in wanted]))


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` centroids nearest to each vector, in no order beyond the first."""
    out = np.empty((len(vectors), n), np.int64)
    half = (centroids ** 2).sum(1) / 2
    for low in range(0, len(vectors), 1024):
        near = vectors[low:low + 1024] @ centroids.T - half
        out[low:low + 1024] = near.argmax(1)[:, None] if n == 1 else \
            np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(centroids) else \
            np.arange(n)[None, :]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(chunks: DataFrame) -> DataFrame:
    """Rows whose vector exists and has no null or non-finite entry."""
    entry = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return chunks.select("chunk_id", "embedding").filter(
        F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", entry), F.lit(False)))


def fit(chunks: DataFrame, n_lists: int, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Centroids by Lloyd's rounds on a sample of bounded size, chosen by the hash of the id."""
    rows = usable(chunks)
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n_rows:
        return np.zeros((0, 0))
    most = max(n_lists, sample_bytes // (4 * width))
    share = min(1.0, most / n_rows)
    picked = rows.withColumn("h", F.xxhash64("chunk_id")).filter(
        F.col("h") / 2.0 ** 64 + 0.5 <= share).orderBy("h").limit(most).select("embedding").toArrow()
    points = _matrix(picked["embedding"].combine_chunks()) if len(picked) else np.zeros((0, width))
    points = np.unique(points, axis=0)         # copies would only make equal centroids
    if len(points) <= n_lists:
        return points
    centroids = points[np.linspace(0, len(points) - 1, n_lists).astype(int)]
    for _ in range(ROUNDS):
        owner = _nearest(points, centroids)[:, 0]
        count = np.bincount(owner, minlength=n_lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        full = count > 0
        centroids[full] = sums[full] / count[full, None]
        if not full.all():                     # an empty list takes the worst served points
            away = ((points - centroids[owner]) ** 2).sum(1)
            centroids[~full] = points[np.argsort(-away, kind="stable")[:(~full).sum()]]
    return centroids


def coded(centroids: np.ndarray):
    """Batches (chunk_id, embedding) -> with list_id, scale and code of the residual."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch.column(1))
            owner = _nearest(vectors, centroids)[:, 0]
            rest = vectors - centroids[owner]
            scale = np.abs(rest).max(1) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            width = code.shape[1]
            binary = pa.Array.from_buffers(pa.binary(width), len(code), [None, pa.py_buffer(
                np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scale), binary, batch.column(1),
                 pa.array(owner.astype(np.int32))],
                names=["chunk_id", "scale", "code", "embedding", "list_id"])
    return run


def build(chunks: DataFrame, path: str, n_lists: int, sample_bytes: int = SAMPLE_BYTES) -> Index:
    """Write the index of all rows (chunk_id, embedding) to a new folder.

    Rows without a usable vector are in no list. Rebalancing splits a list that very many rows
    share into several files.
    """
    spark, rows = chunks.sparkSession, usable(chunks)
    centroids = fit(chunks, n_lists, sample_bytes)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = (f"chunk_id {kinds['chunk_id']}, scale double, code binary, "
              f"embedding {kinds['embedding']}, list_id int")
    spark.createDataFrame([(schema, [c.tolist() for c in centroids])],
                          "schema string, centroids array<array<double>>").write.parquet(
        f"{path}/about")
    found = rows.mapInArrow(coded(centroids), schema)
    found.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(f"{path}/lists")
    return Index(spark, path, schema, centroids)


def load(spark: SparkSession, path: str) -> Index:
    """An index that was written before; its centroids come to the driver."""
    about = spark.read.parquet(f"{path}/about").first()
    return Index(spark, path, about.schema, np.array(about.centroids))


def _keep_best(score, chunk, place, most):
    """Of some scored rows the ``most`` best by score and then id; ``place`` tells list_id."""
    if len(score) > most:
        cut = np.partition(score, len(score) - most)[len(score) - most]
        held = score >= cut
        score, chunk, place = score[held], chunk[held], place[held]
    order = np.lexsort((chunk, -score))[:most]
    return score[order], chunk[order], place[order]


def _scan(shared, most: int):
    """Batches (chunk_id, scale, code, list_id) -> best candidates per query of the task."""
    def run(batches):
        vectors, base, askers = shared.value     # askers: list -> numbers of its queries
        best: dict[int, tuple] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            scale = batch.column(1).to_numpy()
            owner = batch.column(3).to_numpy()
            width = vectors.shape[1]
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, width)
            for number in np.unique(owner).tolist():
                rows = np.nonzero(owner == number)[0]
                asking = askers[number]
                near = (code[rows].astype(np.float64) @ vectors[asking].T) * scale[rows, None]
                near = np.round(near + base[number][None, :], SCORE_DIGITS)
                for column, query in enumerate(asking.tolist()):
                    new = (near[:, column], chunk[rows], np.full(len(rows), number))
                    old = best.get(query)
                    best[query] = _keep_best(*(new if old is None else map(
                        np.concatenate, zip(old, new))), most)
        if best:
            queries = np.repeat(list(best), [len(v[0]) for v in best.values()])
            score, chunk, place = map(np.concatenate, zip(*best.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries, pa.int32()), pa.array(chunk, kind), pa.array(score),
                 pa.array(place, pa.int32())], names=["query_no", "chunk_id", "near", "list_id"])
    return run


def search(index: Index, queries: DataFrame, k: int, n_probe: int, refine: int = REFINE,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Best ``k`` of the ``n_probe`` nearest lists: case_id, query_pos, chunk_id, score, rank.

    Ranks begin at 0, ties go to the smaller id, scores are those of the full vectors. Queries are
    taken in blocks of bounded size; each reads the codes of its lists once and then the vectors
    of ``refine`` x ``k`` candidates per query.
    """
    spark, chunk_kind = index.spark, index.lists().schema["chunk_id"].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = f"case_id {kinds['case_id']}, query_pos {kinds['query_pos']}, chunk_id {chunk_kind}, " \
             "score double, rank int"
    n_probe = min(n_probe, len(index.centroids))
    most, done = refine * k, None
    per_query = W.partitionBy("query_no")
    for keys, matrix in (_query_blocks(queries, block_bytes) if n_probe else ()):
        near = _nearest(matrix, index.centroids, n_probe)
        askers: dict[int, list] = {}
        for query, lists in enumerate(near.tolist()):
            for number in lists:
                askers.setdefault(number, []).append(query)
        askers = {number: np.array(asking) for number, asking in askers.items()}
        base = {number: matrix[asking] @ index.centroids[number] for number, asking in askers.items()}
        shared = spark.sparkContext.broadcast((matrix, base, askers))
        rows = index.lists(sorted(askers))
        found = rows.select("chunk_id", "scale", "code", "list_id").mapInArrow(
            _scan(shared, most), f"query_no int, chunk_id {chunk_kind}, near double, list_id int")
        found = found.withColumn("place", F.row_number().over(
            per_query.orderBy(F.desc("near"), "chunk_id"))).filter(F.col("place") <= most)
        asked = spark.createDataFrame(
            [(i, *key, vector.tolist()) for i, (key, vector) in enumerate(zip(keys, matrix))],
            f"query_no int, case_id {kinds['case_id']}, query_pos {kinds['query_pos']}, "
            "query_vec array<double>")
        score = F.round(cosine(F.col("embedding"), F.col("query_vec")), SCORE_DIGITS)
        scored = found.select("query_no", "chunk_id", "list_id").join(
            rows.select("chunk_id", "list_id", "embedding"), ["list_id", "chunk_id"]).join(
            asked, "query_no").withColumn("score", score)
        block = scored.withColumn("rank", F.row_number().over(
            per_query.orderBy(F.desc("score"), "chunk_id")) - 1).filter(F.col("rank") < k).select(
            "case_id", "query_pos", "chunk_id", "score", "rank")
        done = block if done is None else done.union(block)
    return spark.createDataFrame([], schema) if done is None else done


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results that a search found, over all queries."""
    keys = ["case_id", "query_pos", "chunk_id"]
    want = exact.select(*keys).distinct()
    hit = want.join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0


def enough_probes(index: Index, chunks: DataFrame, queries: DataFrame, k: int,
                  least: float = 0.95, sample: int = SAMPLE_QUERIES) -> int:
    """How many lists to probe so that the recall over a bounded sample of queries is ``least``.

    The sample's exact results come from ``retrieval.top_k``; where the list of each stands among
    the lists of its query tells the recall of every number of probes at once.
    """
    some = queries.orderBy(F.xxhash64("case_id", "query_pos")).limit(sample)
    asked = {(r.case_id, r.query_pos): r.query_vec for r in some.collect()}
    exact = top_k(usable(chunks), some, k, index.lists().schema["chunk_id"].dataType.simpleString())
    placed = exact.select("case_id", "query_pos", "chunk_id").join(
        index.lists().select("chunk_id", "list_id"), "chunk_id").collect()
    if not placed:
        return 1
    centroids, place = index.centroids, {}
    for key, vector in asked.items():
        near = centroids @ np.array(vector) - (centroids ** 2).sum(1) / 2
        place[key] = np.argsort(np.argsort(-near, kind="stable"), kind="stable")
    places = np.sort([place[r.case_id, r.query_pos][r.list_id] for r in placed])
    return int(places[max(0, int(np.ceil(least * len(places))) - 1)]) + 1
