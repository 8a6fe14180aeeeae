"""Telemetry tables with snapshots: a version is one complete list of files, or it is not there.

Layout under the root of a table:

* ``data/<id>/part=<hash of the device>/month=<month>/``: files of one writer, sorted in time. A
  file holds one device and one month, so neither a device with a third of all rows nor a long
  history is written by one task, and a file covers a narrow stretch of time.
* ``manifests/<id>/``: per file its device, month, first and last time and number of rows.
* ``log/<version>.json``: names the manifest of a version. It appears by one rename that does not
  replace an existing file. That rename is the commit: before it a reader sees the version before,
  after it the new one, whatever else was written or lost.

Two writers that start from one version want the same file of the log; the later one gets
``SnapshotConflict``, and what it wrote stays unreferenced. HDFS renames atomically; local folders
test and rename in two steps. Files are never changed or deleted here, so readers of older versions
go on undisturbed.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows per data file; only series far denser than one frame in five seconds have more a month.
FILE_ROWS = 5_000_000
_LOG_NAME = re.compile(r"(\d{10})\.json")
_MANIFEST = "file string, device_id string, month date, first timestamp, last timestamp, rows long"


class SnapshotConflict(RuntimeError):
    """Another writer has committed since the version this one started from."""


def _hadoop(spark: SparkSession, path: str):
    """The store of ``path`` as Hadoop's file context, and a function that makes paths."""
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    full = make(path).getFileSystem(conf).makeQualified(make(path))
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), conf), make


def current(spark: SparkSession, root: str) -> int:
    """The newest version; 0 for a table without any."""
    files, path = _hadoop(spark, root)
    if not files.util().exists(path(f"{root}/log")):
        return 0
    names = (status.getPath().getName() for status in files.util().listStatus(path(f"{root}/log")))
    return max((int(m[1]) for m in map(_LOG_NAME.fullmatch, names) if m), default=0)


def _entry(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/log/{version:010d}.json", wholetext=True).first()[0])


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One row per file of a version (the newest by default); no rows for an empty table."""
    version = current(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(
        f"{root}/manifests/{_entry(spark, root, version)['manifest']}")


def _write_data(df: DataFrame, root: str) -> DataFrame:
    """Write the rows and return the manifest rows of the new files."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    keys = {"part": F.md5(F.coalesce(F.concat(F.lit("d"), "device_id"), F.lit("null"))),
            "month": F.trunc(F.col("timestamp").cast("date"), "month")}
    (df.withColumns(keys).repartition("part", "month")
     .sortWithinPartitions("part", "month", "timestamp")
     .write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("part", "month")
     .parquet(f"{root}/data/{folder}"))
    written = StructType([*df.schema.fields]).add("part", "string").add("month", "date")
    name = F.regexp_extract("_metadata.file_path", r"/part=([0-9a-f]+)/", 1)
    return (spark.read.schema(written).parquet(f"{root}/data/{folder}")
            .select(F.concat(F.lit(f"{folder}/part="), name, F.lit("/"), F.regexp_extract(
                "_metadata.file_path", r"/(month=[^/]+/[^/]+)$", 1)).alias("file"),
                "device_id", "month", "timestamp")
            .groupBy("file", "device_id", "month").agg(
                F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
                F.count(F.lit(1)).alias("rows")))


def _write_manifest(rows: DataFrame, root: str) -> str:
    name = uuid.uuid4().hex
    rows.select(*[c.split()[0] for c in _MANIFEST.split(", ")]).write.parquet(
        f"{root}/manifests/{name}")
    return name


def _commit(spark: SparkSession, root: str, version: int, entry: dict) -> None:
    """Publish a version by one rename; ``SnapshotConflict`` if it exists already."""
    files, path = _hadoop(spark, root)
    target, draft = f"{root}/log/{version:010d}.json", f"{root}/log/_{uuid.uuid4().hex}"
    out = path(draft).getFileSystem(spark._jsc.hadoopConfiguration()).create(path(draft), False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    keep = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        files.rename(path(draft), path(target), spark.sparkContext._gateway.new_array(keep, 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        files.delete(path(draft), False)
        raise SnapshotConflict(f"version {version} of {root} exists already") from error


def _change(df: DataFrame, root: str, base: int | None, kept) -> int:
    spark = df.sparkSession
    base = current(spark, root) if base is None else base
    schema = df.schema.jsonValue()
    types = lambda fields: [(f["name"], f["type"]) for f in fields]
    if base and types(_entry(spark, root, base)["schema"]["fields"]) != types(schema["fields"]):
        raise ValueError("columns differ from those of the table")
    added = _write_data(df, root)
    name = _write_manifest(kept(manifest(spark, root, base), added).unionByName(added), root)
    _commit(spark, root, base + 1, {"manifest": name, "base": base, "schema": schema})
    return base + 1


def append(df: DataFrame, root: str, base: int | None = None) -> int:
    """Add rows; returns the new version.

    ``base`` is the version the caller has read (the newest by default). Null devices and times are
    kept; no rows give a version with the same files. Needs ``device_id`` and ``timestamp``, and
    the columns of the table.
    """
    return _change(df, root, base, lambda old, new: old)


def replace_devices(df: DataFrame, root: str, base: int | None = None) -> int:
    """Replace the devices present in ``df`` in one step and leave every other one alone."""
    def others(old, new):
        gone = new.select(F.col("device_id").alias("gone")).distinct()
        return old.join(gone, F.col("device_id").eqNullSafe(F.col("gone")), "left_anti")
    return _change(df, root, base, others)


def overlapping(files: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of a manifest that may hold frames of a closed window.

    ``windows`` has device_id, start_ts, end_ts. They are cut by month and merged per device and
    month first, so a device with very many windows meets its files with one row a month.
    """
    touched = F.sequence(F.trunc(F.col("start_ts").cast("date"), "month"),
                         F.trunc(F.col("end_ts").cast("date"), "month"), F.expr("interval 1 month"))
    spans = windows.filter("end_ts >= start_ts").select(
        "device_id", "start_ts", "end_ts", F.explode(touched).alias("month")).groupBy(
        "device_id", "month").agg(F.min("start_ts").alias("lo"), F.max("end_ts").alias("hi"))
    return files.join(spans, ["device_id", "month"]).filter(
        (F.col("last") >= F.col("lo")) & (F.col("first") <= F.col("hi"))).select(files.columns)


def read(spark: SparkSession, root: str, version: int | None = None,
         windows: DataFrame | None = None) -> DataFrame:
    """The frames of a version; with ``windows`` only the files that may hold frames of one.

    The files are fixed here, so a commit during the job changes nothing. Their names pass through
    the driver, as those of any Spark scan do. Frames of a file outside all windows are still
    there; ``cases.case_frames`` checks the bounds.
    """
    version = current(spark, root) if version is None else version
    if not version:
        raise ValueError(f"{root} has no version yet")
    files = manifest(spark, root, version)
    if windows is not None:
        files = overlapping(files, windows)
    schema = StructType.fromJson(_entry(spark, root, version)["schema"])
    paths = [f"{root}/data/{r['file']}" for r in files.select("file").distinct().collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
