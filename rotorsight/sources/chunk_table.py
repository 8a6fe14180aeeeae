"""The chunk table: buckets with digests, of which an upsert rewrites those that change.

A chunk belongs to the bucket its id hashes to, so buckets are even whatever the sources are. The
digest of a bucket is a tree of hashes in two steps: SHA-256 of every row, then SHA-256 of the
number of rows and the sums of the four quarters of their hashes. Sums do not depend on the order of
rows or tasks and combine before the shuffle, so no bucket is ever gathered in one place. They tell
builds apart; they are no defence against forged rows.

A version lists its buckets with folder, rows and digest, and is committed by the one rename of
``snapshots``: a failure at any point leaves the version before, two writers conflict visibly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import materialise
from . import snapshots

#: Buckets of a new table, fixed for its life; aim at 128 MB to 1 GB of text in each.
BUCKETS = 64
_MANIFEST = "bucket int, folder string, rows long, digest string"
_QUARTERS = (1, 17, 33, 49)


def _keyed(chunks: DataFrame, buckets: int) -> DataFrame:
    """One row per chunk id with its bucket and hash; of different copies the greatest hash."""
    columns = sorted(c for c in chunks.columns if c != "chunk_id")
    text = F.to_json(F.struct("chunk_id", *columns), {"ignoreNullFields": "false"})
    best = F.max_by(F.struct(*chunks.columns, "row_sha"), "row_sha").alias("r")
    return (chunks.withColumn("row_sha", F.unhex(F.sha2(text, 256)))
            .groupBy(F.col("chunk_id").alias("id")).agg(best)
            .select("r.*", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")))


def _digests(rows: DataFrame) -> DataFrame:
    """Rows and digest per bucket, from the hashes alone."""
    text = F.hex("row_sha")
    quarter = lambda at: F.sum(F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = {f"s{at}": quarter(at) for at in _QUARTERS}
    grouped = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), *[s.alias(name) for name, s in sums.items()])
    return grouped.select("bucket", "rows", F.sha2(F.concat_ws(":", *[
        F.col(c).cast("string") for c in ("rows", *sums)]), 256).alias("digest"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One row per bucket of a version (the newest by default): bucket, folder, rows, digest."""
    version = snapshots.current(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], _MANIFEST)
    name = snapshots._entry(spark, root, version)["manifest"]
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/{name}")


def table_digest(spark: SparkSession, root: str, version: int | None = None) -> str:
    """One hash of all rows of a version: the root over the digests of its buckets."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "digest")))
    lines = F.transform(pairs, lambda p: F.concat_ws(":", p["bucket"].cast("string"), p["digest"]))
    return manifest(spark, root, version).agg(F.sha2(F.array_join(lines, "\n"), 256)).first()[0]


def changed_buckets(spark: SparkSession, root: str, old: int, new: int) -> list[int]:
    """Buckets that differ between two versions; all others hold the same rows."""
    a, b = (manifest(spark, root, v).select("bucket", "digest") for v in (old, new))
    rows = a.exceptAll(b).union(b.exceptAll(a)).select("bucket").distinct()
    return sorted(r["bucket"] for r in rows.collect())


def _stored(spark: SparkSession, root: str, listed: DataFrame, schema: StructType) -> DataFrame:
    """Rows with their hashes of the buckets in ``listed``, whose number is fixed per table."""
    paths = [f"{root}/data/{r['folder']}/bucket={r['bucket']}" for r in listed.collect()]
    full = StructType([*schema.fields]).add("row_sha", "binary")
    return spark.read.schema(full).parquet(*paths) if paths else spark.createDataFrame([], full)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The chunks of a version (the newest by default)."""
    version = snapshots.current(spark, root) if version is None else version
    if not version:
        raise ValueError(f"{root} has no version yet")
    schema = StructType.fromJson(snapshots._entry(spark, root, version)["schema"])
    return _stored(spark, root, manifest(spark, root, version), schema).drop("row_sha")


def _write(rows: DataFrame, root: str) -> DataFrame:
    """Write whole buckets, one task each, and return their manifest rows."""
    folder = uuid.uuid4().hex
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{folder}")
    hashes = rows.sparkSession.read.schema("row_sha binary, bucket int").parquet(
        f"{root}/data/{folder}")
    return _digests(hashes).withColumn("folder", F.lit(folder))


def _publish(spark: SparkSession, root: str, base: int, kept: DataFrame, written: DataFrame,
             schema: StructType, buckets: int) -> int:
    name = uuid.uuid4().hex
    order = [c.split()[0] for c in _MANIFEST.split(", ")]
    kept.select(order).unionByName(written.select(order)).write.parquet(f"{root}/manifests/{name}")
    snapshots._commit(spark, root, base + 1, {
        "manifest": name, "base": base, "schema": schema.jsonValue(), "buckets": buckets})
    return base + 1


def _start(chunks: DataFrame, root: str, buckets: int):
    """Newest version, number of buckets, schema and keyed rows of a build."""
    spark = chunks.sparkSession
    base = snapshots.current(spark, root)
    schema = chunks.schema
    if base:
        entry = snapshots._entry(spark, root, base)
        buckets, schema = entry["buckets"], StructType.fromJson(entry["schema"])
        if {f.name: f.dataType for f in schema} != {f.name: f.dataType for f in chunks.schema}:
            raise ValueError("columns differ from those of the table")
        chunks = chunks.select(schema.names)
    return base, buckets, schema, materialise(_keyed(chunks, buckets))


def _among(column: str, values: list[int]):
    return F.col(column).isin(values) if values else F.lit(False)


def upsert(chunks: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Put chunks over those of the same id; returns the version that holds them.

    Of the stored buckets that are touched only ids and hashes are read; those in which a row is new
    or differs are rewritten. If none is, nothing is written and the version stays. No rows change
    nothing; ``buckets`` counts for a new table only.
    """
    spark = chunks.sparkSession
    base, buckets, schema, fresh = _start(chunks, root, buckets)
    listed = manifest(spark, root, base)
    numbers = lambda df: sorted(r["bucket"] for r in df.select("bucket").distinct().collect())
    ids = _stored(spark, root, listed.filter(_among("bucket", numbers(fresh))), schema).select(
        F.col("chunk_id").alias("id"), F.col("row_sha").alias("sha"))
    same = F.col("chunk_id").eqNullSafe(F.col("id"))
    changed = numbers(fresh.select("bucket", "chunk_id", "row_sha").join(
        ids, same & (F.col("row_sha") == F.col("sha")), "left_anti"))
    if not changed:
        return base
    over = fresh.filter(_among("bucket", changed))
    under = _stored(spark, root, listed.filter(_among("bucket", changed)), schema).join(
        over.select(F.col("chunk_id").alias("id")), same, "left_anti").withColumn(
        "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int"))
    return _publish(spark, root, base, listed.filter(~_among("bucket", changed)),
                    _write(under.unionByName(over), root), schema, buckets)


def rebuild(chunks: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Make the table hold exactly these chunks; returns the version that does.

    Digests are compared bucket by bucket, so stored rows are not read at all and equal buckets keep
    their files; if all are equal, nothing is written. A build without rows is refused.
    """
    spark = chunks.sparkSession
    base, buckets, schema, fresh = _start(chunks, root, buckets)
    if fresh.isEmpty():
        raise ValueError("a build without chunks does not replace a table")
    listed = manifest(spark, root, base)
    both = listed.select("bucket", "digest").join(
        _digests(fresh).select("bucket", F.col("digest").alias("new")), "bucket", "full")
    differ = both.filter(~F.col("digest").eqNullSafe(F.col("new"))).select("bucket", "new").collect()
    if not differ:
        return base
    write = [r["bucket"] for r in differ if r["new"] is not None]
    kept = listed.filter(~_among("bucket", [r["bucket"] for r in differ]))
    written = _write(fresh.filter(_among("bucket", write)), root) if write else kept.limit(0)
    return _publish(spark, root, base, kept, written, schema, buckets)
