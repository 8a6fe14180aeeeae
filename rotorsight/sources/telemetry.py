"""Telemetry readers, checks and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import limits as L
from ..functions.scalars import parse_time

TELEMETRY_SCHEMA = ", ".join(
    f"{c} {'timestamp' if c == 'timestamp' else 'double' if c in L.READINGS else 'string'}"
    for c in L.TELEMETRY_COLUMNS)


def missing_columns(df: DataFrame) -> list[str]:
    """Required columns that are absent; checked on the schema, no data is read."""
    return sorted(set(L.TELEMETRY_COLUMNS) - set(df.columns))


def require_columns(df: DataFrame) -> DataFrame:
    if missing := missing_columns(df):
        raise ValueError(f"telemetry lacks columns: {missing}")
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path)).select(*L.TELEMETRY_COLUMNS)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table; filters on device and time are pushed down by Spark."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return require_columns(reader.options(**options).load()).select(*L.TELEMETRY_COLUMNS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header. Every field is read as text, so 'NONE' and '' stay what they are."""
    header = spark.read.option("header", True).csv(path)
    raw = require_columns(header)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in L.TELEMETRY_COLUMNS])


def strict_readings(raw: DataFrame) -> DataFrame:
    """Typed telemetry; a reading that does not parse fails the job."""
    number = {c: F.expr(f"CASE WHEN try_cast(`{c}` AS DOUBLE) IS NULL THEN "
                        f"cast(raise_error(concat('not a number in {c}: ', `{c}`)) AS DOUBLE) "
                        f"ELSE try_cast(`{c}` AS DOUBLE) END") for c in L.READINGS}
    typed = raw.withColumns(number)
    return typed.withColumn("timestamp", parse_time("timestamp")).select(*L.TELEMETRY_COLUMNS)


def violations(df: DataFrame) -> DataFrame:
    """Rows that break the contract: (check, device_id, timestamp, detail).

    Readings must parse and be finite, ids must not be blank, the state must be in the
    vocabulary, and a device must not repeat a timestamp. Row checks need no shuffle; the
    duplicate check aggregates before it shuffles.
    """
    stamp = F.col("timestamp").cast("string")
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    finite = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) \
        & (F.abs(number(c)) != F.lit(float("inf")))
    problems = F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull() & number(c).isNull(),
                 F.struct(F.lit("not_numeric").alias("check"), F.lit(c).alias("detail")))
          .when(~F.coalesce(finite(c), F.lit(False)),
                F.struct(F.lit("not_finite").alias("check"), F.lit(c).alias("detail")))
          for c in L.READINGS],
        F.when(F.coalesce(F.trim("device_id") == "", F.lit(True)),
               F.struct(F.lit("blank_id").alias("check"), F.lit("device_id").alias("detail"))),
        F.when(~F.coalesce(F.col("operating_state").isin(L.STATES), F.lit(False)),
               F.struct(F.lit("unknown_state").alias("check"),
                        F.coalesce("operating_state", F.lit("")).alias("detail")))))
    per_row = (df.select("device_id", stamp.alias("timestamp"), F.explode(problems).alias("p"))
               .select("p.check", "device_id", "timestamp", "p.detail"))
    repeated = (df.groupBy("device_id", stamp.alias("timestamp")).agg(F.count("*").alias("n"))
                .filter("n > 1")
                .select(F.lit("duplicate_time").alias("check"), "device_id", "timestamp",
                        F.col("n").cast("string").alias("detail")))
    return per_row.unionByName(repeated)


def history(df: DataFrame, device_id: str) -> DataFrame:
    """All frames of one device, ascending."""
    return df.filter(F.col("device_id") == device_id).select(*L.TELEMETRY_COLUMNS) \
        .orderBy("timestamp")


def window(df: DataFrame, device_id: str, start: str, end: str) -> DataFrame:
    """Frames of one device in a closed time window, ascending. No frames is not an error."""
    inside = F.col("timestamp").between(parse_time(F.lit(start)), parse_time(F.lit(end)))
    return (df.filter((F.col("device_id") == device_id) & inside)
            .select(*[c for c in L.TELEMETRY_COLUMNS if c != "device_id"]).orderBy("timestamp"))


# ---- writers -------------------------------------------------------------------------------------

def _placed(df: DataFrame) -> DataFrame:
    """Days of a device in one file each, so a device with very many rows is written in parallel."""
    return df.repartition("device_id", F.to_date("timestamp")) \
        .sortWithinPartitions("device_id", "timestamp")


def append(df: DataFrame, path: str) -> None:
    """Append, partitioned by device and sorted in time so that row-group statistics prune.

    Same layout as ``replace_device``, so both may write to one table.
    """
    (_placed(df).write.mode("append").partitionBy("device_id").parquet(path))


def replace_device(df: DataFrame, path: str) -> None:
    """Replace the devices present in ``df`` and leave every other device alone.

    Dynamic overwrite swaps whole ``device_id`` partitions at commit, with all their days, one
    after another: a job that fails before its commit changes nothing, but who reads during the
    commit, or after a crash in it, may see some devices new and some old. Tables written by
    ``snapshots.replace_devices`` change in one step.
    """
    (_placed(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("device_id").parquet(path))


def export_by_day(df: DataFrame, labels: DataFrame, path: str) -> None:
    """CSV per day; the folder name carries the day's label (see ``alarms.day_labels``)."""
    dated = df.withColumn("day", F.to_date("timestamp"))
    (dated.join(labels.select("device_id", "day", "label"), ["device_id", "day"], "left")
     .repartition("device_id", "day").sortWithinPartitions("device_id", "timestamp")
     .write.mode("overwrite").option("header", True).partitionBy("day", "label").csv(path))


def export_full(df: DataFrame, path: str) -> str:
    """Whole history in time order, in a folder named by its first and last day.

    Range-partitioned part files instead of one file: concatenated in name order they are the
    full export, and no task has to write everything.
    """
    first, last = df.agg(F.to_date(F.min("timestamp")), F.to_date(F.max("timestamp"))).first()
    target = f"{path}/telemetry_full_{first}_to_{last}"
    (df.repartitionByRange("timestamp").sortWithinPartitions("timestamp")
     .write.mode("overwrite").option("header", True).csv(target))
    return target


def export_by_state(df: DataFrame, path: str) -> None:
    """CSV folders by operating state."""
    (df.write.mode("overwrite").option("header", True).partitionBy("operating_state").csv(path))
