"""The seventeen segment rules, their window-level list and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import limits as L
from ..functions.scalars import above, at_least, below, deviation_pct, iso

CATALOG_SCHEMA = "code string, label string, source string, extra_field string"


def rule_catalog(spark: SparkSession) -> DataFrame:
    """Seventeen rows: small and fixed, so joins on it broadcast."""
    return spark.createDataFrame(L.RULE_CATALOG, CATALOG_SCHEMA)


def rule_hits() -> Column:
    """Rule codes of one segment in judging order; shutdown segments have none."""
    temp, slope = F.col("max_temp_de"), F.col("slope_temp_de")
    de, nde = F.coalesce("max_vib_de", F.lit(0.0)), F.coalesce("max_vib_nde", F.lit(0.0))
    gate = at_least(temp, L.TEMP_TRIP) | (
        at_least(temp, L.SLOPE_ACTIVE_TEMP) & (F.col("duration_sec") >= L.SLOPE_MIN_SECONDS)
        & (F.col("data_points") >= L.SLOPE_MIN_ROWS))
    flowing = above("avg_flow", L.FLOW_ACTIVE)
    unstable = (F.col("data_points") >= L.CV_MIN_ROWS) & (
        at_least(F.coalesce("cv_flow_peak", "cv_flow"), L.CV_LIMIT_PCT)
        | at_least(F.coalesce("cv_press_peak", "cv_press"), L.CV_LIMIT_PCT))
    hits = F.array_compact(F.array(
        F.when(at_least(temp, L.TEMP_TRIP), "BEARING_TEMP_DE_TRIP")
         .when(at_least(temp, L.TEMP_WARN), "BEARING_TEMP_DE_WARN"),
        F.when(gate & at_least(slope, L.SLOPE_SHARP) & at_least(temp, L.TEMP_WARN),
               "BEARING_TEMP_DE_RAMP_SHARP")
         .when(gate & at_least(slope, L.SLOPE_SLOW), "BEARING_TEMP_DE_RAMP_SLOW"),
        F.when(above("max_vib_de", L.VIB_TRIP), "VIB_DE_TRIP")
         .when(above("max_vib_de", L.VIB_WARN), "VIB_DE_WARN"),
        F.when(above("max_vib_nde", L.VIB_TRIP), "VIB_NDE_TRIP")
         .when(above("max_vib_nde", L.VIB_WARN), "VIB_NDE_WARN"),
        F.when((de > L.VIB_SYNC_HIGH) & (nde > L.VIB_SYNC_HIGH), "VIB_BOTH_HIGH")
         .when((de > L.VIB_SYNC_HIGH) & (nde < L.VIB_SYNC_LOW), "VIB_DE_DOMINANT")
         .when((nde > L.VIB_SYNC_HIGH) & (de < L.VIB_SYNC_LOW), "VIB_NDE_DOMINANT"),
        F.when(flowing & (F.abs(deviation_pct("avg_flow", L.RATED_FLOW)) > L.DEV_FLOW_PCT),
               "FLOW_DEV"),
        F.when(flowing & (F.abs(deviation_pct("avg_press_out", L.RATED_PRESS_OUT))
                          > L.DEV_PRESS_PCT), "PRESS_OUT_DEV"),
        F.when(unstable, "CV_UNSTABLE"),
        F.when(below("avg_press_in", L.PRESS_IN_WARN), "PRESS_IN_LOW"),
        F.when(at_least("max_motor_current", L.CURRENT_HIGH), "CURRENT_HIGH")
         .when(below("avg_motor_current", L.CURRENT_LOW), "CURRENT_LOW"),
    ))
    return F.when(F.col("state").isin(L.ACTIVE_STATES), hits) \
        .otherwise(F.array().cast("array<string>"))


def judge(segments: DataFrame) -> DataFrame:
    """Add ``rule_hits`` to segment rows. Row-local, no shuffle."""
    return segments.withColumn("rule_hits", rule_hits())


def hit_rows(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per segment and code with the catalogue's label and the rendered sentence."""
    hits = segments.select("*", F.posexplode("rule_hits").alias("pos", "code")).drop("rule_hits")
    labelled = hits.join(F.broadcast(catalog), "code", "left") \
        .withColumn("label", F.coalesce("label", "code"))
    when = F.when((F.col("extra_field") == "ramp_start_time")
                  & F.col("ramp_start_time").isNotNull(),
                  F.format_string(L.RAMP_TEMPLATE, F.date_format("ramp_start_time", "HH:mm:ss"))) \
        .otherwise("")
    return labelled.withColumn("sentence", F.concat(
        F.lit("- ["), "state", F.lit("段 "), F.date_format("start", "HH:mm:ss"), F.lit("~"),
        F.date_format("end", "HH:mm:ss"), F.lit("] "), "label", F.lit("（"), "code", F.lit("）"),
        when))


def window_codes(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct codes per key in the order they first appeared (segment, then rule order).

    Reduced to one row per code before the list is built, so the list never holds more than the
    rule catalogue. A key without hits has an empty list.
    """
    firsts = (segments.select(*keys, "seg_index", F.posexplode("rule_hits").alias("pos", "code"))
              .groupBy(*keys, "code").agg(F.min(F.struct("seg_index", "pos")).alias("first")))
    listed = firsts.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "code"))), lambda x: x["code"])
        .alias("rule_codes"))
    return segments.select(*keys).distinct().join(listed, keys, "left").select(
        *keys, F.coalesce("rule_codes", F.array().cast("array<string>")).alias("rule_codes"))


def segment_text() -> Column:
    """Readable block for one segment."""
    return F.concat(
        F.lit("◆ 阶段 ["), "state", F.lit("] "), iso("start"), F.lit(" ~ "), iso("end"),
        F.format_string("\n    时长 %ds，%d 点", "duration_sec", "data_points"),
        F.concat(F.lit("\n    流量: avg="), "avg_flow", F.lit(" m³/h, CV="), "cv_flow", F.lit("%")),
        F.concat(F.lit("\n    出口压力: avg="), "avg_press_out", F.lit(" MPa, CV="), "cv_press",
                 F.lit("%")),
        F.concat(F.lit("\n    驱动端温度: slope="), "slope_temp_de", F.lit(" ℃/min, max="),
                 "max_temp_de", F.lit(" ℃")),
        F.concat(F.lit("\n    驱动端振动: slope="), "slope_vib_de", F.lit(" mm/s/min, max="),
                 "max_vib_de", F.lit(" mm/s")),
        F.concat(F.lit("\n    非驱动端温度: max="), "max_temp_nde", F.lit(" ℃, 振动: max="),
                 "max_vib_nde", F.lit(" mm/s")),
        F.concat(F.lit("\n    电机电流: avg="), "avg_motor_current", F.lit(" A, max="),
                 "max_motor_current", F.lit(" A")))


def overall_text() -> Column:
    """Readable block for the whole window; expects the overall view plus ``alarm_text``."""
    return F.concat(
        F.concat(F.lit("- 总数据点数："), F.col("total_points").cast("string")),
        F.concat(F.lit("\n- 时间窗口："), iso("window_start"), F.lit(" ~ "), iso("window_end")),
        F.concat(F.lit("\n- 起始状态："), "start_state", F.lit("\n- 结束状态："), "end_state"),
        F.concat(F.lit("\n- 是否发生停机："),
                 F.when(F.col("has_shutdown"), "True").otherwise("False")),
        F.concat(F.lit("\n- 阶段数："), F.col("phase_count").cast("string")),
        F.concat(F.lit("\n- 窗口内出现过的报警码："),
                 F.when(F.col("alarm_text") != "", F.col("alarm_text")).otherwise("无")),
        F.concat(F.lit("\n- 全程最高温度(驱动端)："), F.col("max_temp_de").cast("string"),
                 F.lit(" ℃")),
        F.concat(F.lit("\n- 全程最高振动(驱动端)："), F.col("max_vib_de").cast("string"),
                 F.lit(" mm/s")))
