"""Cases: their time windows, the frames inside, and the state of each evidence source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import limits as L
from ..functions.scalars import iso, parse_time, strip
from .runs import Series, time_slice

# Case frames are cut into slices of the default case length: a case touches one or two.
CASE_SLICE = L.DEFAULT_WINDOW_MINUTES * 60
CASE_SERIES = Series(keys=("device_id", "trace_id"), slice_seconds=CASE_SLICE)


def _blank(column) -> Column:
    return F.coalesce(strip(column) == "", F.lit(True))


def default_windows(cases: DataFrame, now: Column | str = "reported_at") -> DataFrame:
    """If either bound is blank, both become the half hour before ``now``."""
    moment = F.col(now) if isinstance(now, str) else now
    missing = _blank("start_time") | _blank("end_time")
    start = F.when(missing, iso(moment - F.expr(f"INTERVAL {L.DEFAULT_WINDOW_MINUTES} MINUTES"))) \
        .otherwise(strip("start_time"))
    end = F.when(missing, iso(moment)).otherwise(strip("end_time"))
    return cases.withColumns({"start_time": start, "end_time": end}).withColumns(
        {"start_ts": parse_time("start_time"), "end_ts": parse_time("end_time")})


def case_frames(cases: DataFrame, frames: DataFrame, slice_seconds: int = CASE_SLICE) -> DataFrame:
    """Frames inside each case's closed window.

    A range join made an equi-join: every case is expanded to the time slices it touches, both
    sides meet on ``(device_id, slice)`` and the bounds are checked afterwards. A device with a
    third of all frames is spread over its slices, and the partitioning by slice is reused by the
    segmentation that follows.
    """
    touched = F.sequence(time_slice("start_ts", slice_seconds), time_slice("end_ts", slice_seconds))
    spans = (cases.filter(~_blank("device_id") & (F.col("end_ts") >= F.col("start_ts")))
             .select("trace_id", "device_id", "start_ts", "end_ts",
                     F.explode(touched).alias("slice")))
    sliced = frames.withColumn("slice", time_slice("timestamp", slice_seconds))
    return (sliced.join(spans, ["device_id", "slice"])
            .filter(F.col("timestamp").between(F.col("start_ts"), F.col("end_ts")))
            .drop("start_ts", "end_ts"))


def coverage(cases: DataFrame) -> DataFrame:
    """Expected frames, coverage and the data status with its reason; expects ``total_points``.

    ``total_points`` null or 0 means no frame was found. ``data_failed`` (optional boolean) marks
    cases whose analysis raised an error.
    """
    seconds = F.expr("unix_seconds(end_ts) - unix_seconds(start_ts)")
    expected = F.floor(seconds / L.SAMPLE_SECONDS).cast("long") + 1
    points = F.coalesce("total_points", F.lit(0)).cast("long")
    pct = F.when(expected > 0, points / expected * 100).otherwise(F.lit(100.0))
    no_device = _blank("device_id")
    failed = F.coalesce("data_failed", F.lit(False)) if "data_failed" in cases.columns \
        else F.lit(False)
    no_window = F.col("start_ts").isNull() | F.col("end_ts").isNull()
    partial = F.col("coverage_pct") < L.COVERAGE_MIN_PCT
    status = (F.when(no_device, "EMPTY").when(failed, "FAILED").when(no_window, "EMPTY")
              .when(F.col("total_points") == 0, "EMPTY").when(partial, "PARTIAL").otherwise("OK"))
    reason = (F.when(no_device, "无设备码：未提供设备编号，跳过时序数据分析")
              .when(failed, "时序数据处理异常")
              .when(no_window, "未提供时间窗口：本次未做时序分析")
              .when(F.col("total_points") == 0, "指定时间窗口内无 SCADA 记录")
              .when(partial, F.format_string(
                  "窗口内缺失约 %s%% 的数据（理论 %d 点，实际 %d 点）",
                  F.format_number(100 - F.col("coverage_pct"), 0), "expected_points",
                  "total_points"))
              .otherwise(""))
    return (cases.withColumns({"expected_points": expected, "total_points": points,
                               "coverage_pct": pct})
            .withColumns({"data_status": status, "data_reason": reason}))


def engineer_text(cases: DataFrame) -> DataFrame:
    """Status and text of the operator's note."""
    note = strip(F.coalesce("user_query", F.lit("")))
    return cases.withColumns({
        "text_status": F.when(note == "", "EMPTY").otherwise("RECORDED"), "text": note})


def merge_evidence(cases: DataFrame, *parts: DataFrame) -> DataFrame:
    """Cases with every evidence branch attached; an absent branch leaves nulls, not a lost row."""
    for part in parts:
        cases = cases.join(part, "trace_id", "left")
    return cases


def not_yet_done(cases: DataFrame, finished: DataFrame) -> DataFrame:
    """Cases without a stored result of the step."""
    return cases.join(finished.select("trace_id"), "trace_id", "left_anti")


def reuse_finished(fresh: DataFrame, finished: DataFrame) -> DataFrame:
    """Stored results plus the newly computed ones."""
    return finished.unionByName(fresh)


def offline_descriptions(cases: DataFrame) -> DataFrame:
    """One THRESHOLD row per rule code, or a single OTHER row when nothing fired."""
    rows = cases.filter(F.col("data_status") != "EMPTY").select(
        "trace_id", F.posexplode_outer("flags").alias("pos", "code"))
    hit = F.col("code").isNotNull()
    return rows.select(
        "trace_id", F.coalesce("pos", F.lit(0)).alias("pos"),
        F.when(hit, "THRESHOLD").otherwise("OTHER").alias("kind"),
        F.when(hit, F.concat(F.lit("离线规则计算命中 "), "code", F.lit("；未调用语言模型。")))
         .otherwise("离线规则计算未命中阈值；未调用语言模型。").alias("description"),
        F.array_compact(F.array("code")).alias("evidence"))


def known_evidence(evidence: Column, allowed: Column) -> Column:
    """Evidence names that really occur in the material, in their own order."""
    return F.filter(evidence, lambda x: F.array_contains(allowed, x))


def description_warnings(descriptions: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases whose descriptions are longer than the events in them justify.

    ``cases`` carries ``phase_count`` and ``effective`` (alarm codes).
    """
    total = descriptions.groupBy("trace_id").agg(F.sum(F.length("description")).alias("chars"))
    switches = F.greatest(F.lit(0), F.col("phase_count") - 1)
    limit = F.least(F.lit(1000), 500 + 40 * switches + 20 * F.size("effective"))
    return (total.join(cases.select("trace_id", "phase_count", "effective"), "trace_id")
            .withColumn("char_limit", limit)
            .withColumn("too_long", F.col("chars") > F.col("char_limit"))
            .select("trace_id", "chars", "char_limit", "too_long"))
