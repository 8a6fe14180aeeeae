"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise as cut, shared_folder as shared_dir

#: Rows and bytes per Arrow batch. Texts may be long, so batches are kept small.
ARROW_ROWS, ARROW_BYTES = "1000", str(8 << 20)


__all__ = ["components", "cut", "hot_keys", "id_text", "prepare", "shared_dir", "text_hash"]


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def id_text(name: str = "doc_id") -> Column:
    """The id as text, so that null ids can be join keys."""
    return F.coalesce(F.col(name).cast("string"), F.lit("\u0000null"))


def text_hash(name: str = "text") -> Column:
    """64-bit hash of a text; null counts as empty. Tells rows with one id apart."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def hot_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, with their count: below 1 / share rows.

    That bound holds whatever the size of the data, so the result may be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.count()
    return counts.filter(F.col("n_rows") > max(1.0, share * total))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(u, v)``: one row ``(node, root)`` per node.

    The root is the smallest node. Alternates the large-star and the small-star step; every
    round is a group and a join, written to the shared folder. Hubs are only ever aggregated
    (map-side combined) and the join against their single row is split by AQE.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"),
                                            F.least("u", "v").alias("v")).distinct())
    mark = _state(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.filter("u <> v").distinct())
        before, mark = mark, _state(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                 .first())
