"""Alarm sets, counts and labels; states derived from alarms with a one-frame hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import limits as L
from ..functions.scalars import alarm_codes, alarm_from_readings, is_alarm
from ..session import materialise
from .runs import Series, prefix_last, time_slice

SPECIAL_STATES = ["TRIP_SHUTDOWN", "CRITICAL_CAVITATION", "UNBALANCE_MISALIGNMENT"]


def code_rows(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row per frame and alarm code."""
    parts = frames.select(*keys, F.explode(F.split("alarm_code", ";")).alias("code"))
    return parts.withColumn("code", F.trim("code")).filter(~F.col("code").isin(L.NO_ALARM))


def alarm_sets(frames: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """Distinct codes of the window and the codes of its last alarmed frame, per key.

    Both are partial aggregates: a code list per key is only as long as the code vocabulary. A
    key without an alarm has empty lists.
    """
    valid = is_alarm("alarm_code")
    codes = code_rows(frames.filter(valid), keys).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("code")).alias("effective"))
    last = frames.groupBy(*keys).agg(alarm_codes(F.max_by(
        F.when(valid, F.col("alarm_code")), F.when(valid, F.col(ts)))).alias("last"))
    empty = F.array().cast("array<string>")
    joined = last.join(codes, keys, "left").select(
        *keys, F.coalesce("effective", empty).alias("effective"),
        F.coalesce("last", empty).alias("last"))
    return joined.withColumn("all", F.col("effective"))


def state_distribution(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys, "operating_state").agg(
        F.count(F.lit(1)).alias("frames"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))


def alarm_counts(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames per alarm code."""
    return (code_rows(frames, keys).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("frames")))


def day_labels(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Label of each day: seal_leak, fault, warning, abnormal or normal."""
    codes = F.split("alarm_code", ";")
    seen = lambda code: F.bool_or(F.array_contains(codes, code))
    flags = frames.groupBy(*keys, F.to_date("timestamp").alias("day")).agg(
        seen("TAHH-101").alias("tahh"), seen("VAHH-102").alias("vahh"),
        seen("VAH-102").alias("vah"), seen("TAH-101").alias("tah"),
        F.bool_or(F.col("alarm_code") != "NONE").alias("any"), F.count(F.lit(1)).alias("frames"))
    label = (F.when(~F.col("any"), "normal").when(F.col("tahh"), "seal_leak")
             .when(F.col("vahh"), "fault").when(F.col("vah") | F.col("tah"), "warning")
             .otherwise("abnormal"))
    return flags.select(*keys, "day", label.alias("label"), "frames")


def state_alarm_conflicts(frames: DataFrame) -> DataFrame:
    """Frames whose state and alarm contradict each other."""
    alarmed = F.col("alarm_code") != "NONE"
    return frames.filter(alarmed & F.col("operating_state").isin("NORMAL", L.SHUTDOWN)).withColumn(
        "conflict", F.when(F.col("operating_state") == "NORMAL", "NORMAL 段不应有报警码")
        .otherwise("停机段报警码应为 NONE"))


def _own_marker(held: Column, intent: str) -> Column:
    """State fixed by the frame itself and the hold; null where the past decides."""
    return (F.when(F.col(intent).isin(SPECIAL_STATES), F.col(intent))
            .when(F.col("alarm") != "NONE", "WARNING").when(held, "WARNING")
            .when(F.col(intent) == "DEGRADING", "DEGRADING")
            .when(F.col("temp_de") < L.HOLD_TEMP, "NORMAL"))


def _holds(alarm: Column, intent: Column) -> Column:
    return F.coalesce((alarm != "NONE") & ~intent.isin(SPECIAL_STATES), F.lit(False))


def resolve_states(frames: DataFrame, series: Series = Series(),
                   intent: str = "phase_intent") -> DataFrame:
    """Operating state from alarms and the intended phase, with hysteresis.

    An alarm that clears is held for one frame, and a degrading device stays degrading while at
    least 65 degrees warm. The second rule looks back without limit, so the last fixed state is
    carried across slices by ``prefix_last``; rows are only ever ordered inside a slice.
    """
    keys, part = list(series.keys), [*series.keys, "slice"]
    by_time = W.partitionBy(*part).orderBy(series.ts)
    held = _holds(F.lag("alarm").over(by_time), F.lag(intent).over(by_time))
    rows = (frames.withColumn("slice", time_slice(series.ts, series.slice_seconds))
            .withColumn("alarm", alarm_from_readings(F.col(intent) == L.SHUTDOWN))
            .withColumn("held", held).withColumn("rn", F.row_number().over(by_time))
            .withColumn("marker", F.when(F.col("rn") > 1, _own_marker(F.col("held"), intent)))
            .withColumn("seen", F.last("marker", ignorenulls=True).over(by_time)))
    units = materialise(rows.groupBy(*part).agg(
        F.max_by(F.struct(F.col("alarm").alias("alarm"), F.col(intent).alias("intent")),
                 series.ts).alias("last_row"),
        F.min_by(F.struct(_own_marker(F.lit(False), intent).alias("free"),
                          _own_marker(F.lit(True), intent).alias("held")), series.ts)
        .alias("first_row"),
        F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col(series.ts)))
        .alias("later_marker")))
    before = prefix_last(units, keys, "slice", ["last_row"], series.block) \
        .withColumnRenamed("last_row", "previous")
    resolved = units.join(before, part).withColumn("first_marker", F.when(
        _holds(F.col("previous.alarm"), F.col("previous.intent")), F.col("first_row.held"))
        .otherwise(F.col("first_row.free"))) \
        .withColumn("marker", F.coalesce("later_marker", "first_marker"))
    carried = prefix_last(resolved.select(*part, "marker"), keys, "slice", ["marker"],
                          series.block).withColumnRenamed("marker", "carried")
    carry = resolved.select(*part, "first_marker").join(carried, part)
    own = F.when(F.col("rn") == 1, F.col("first_marker")).otherwise(F.col("marker"))
    past = F.coalesce("seen", "first_marker", "carried")
    return (rows.join(carry, part)
            .withColumn("state", F.coalesce(own, F.when(past == "DEGRADING", "DEGRADING")
                                            .otherwise("NORMAL")))
            .drop("slice", "held", "rn", "marker", "seen", "first_marker", "carried"))
