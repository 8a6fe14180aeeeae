"""Diagnosis of any number of cases in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import alarm_codes, iso
from ..operators import attribution, cases as C, delivery, manual, rules, safety, segments, vision
from ..session import materialise
from ..sources.config import RiskConfig

OVERALL = ["total_points", "phase_count", "max_temp_de", "max_vib_de", "max_temp_nde",
           "max_vib_nde", "avg_flow", "min_press_in", "start_state", "end_state", "has_shutdown"]


def analyse_telemetry(cases: DataFrame, frames: DataFrame) -> DataFrame:
    """Data evidence per case: window figures, rule codes, alarm sets.

    Reads the frames once; everything after the runs works on their small output.
    """
    series = C.CASE_SERIES
    runs = segments.telemetry_runs(C.case_frames(cases, frames), series, alarms=True,
                                   ramps=False)
    # A few rows per case, read by the overall figures and by the rule list; ramp starts and the
    # figures that only the rules read are not kept.
    seg = materialise(rules.judge(segments.segment_metrics(runs, series)).select(
        *series.keys, "seg_index", "state", "start", "end", "data_points", "rule_hits"))
    overall = segments.overall_metrics(runs, seg, series).select("trace_id", *OVERALL)
    codes = rules.window_codes(seg, ["trace_id"]).withColumnRenamed("rule_codes", "flags")
    alarms = runs.groupBy("trace_id").agg(
        F.array_distinct(F.flatten(F.collect_set("alarm_set"))).alias("strings"),
        alarm_codes(F.max("last_alarm")["alarm_code"]).alias("last")).select(
        "trace_id", "last", F.array_sort(F.array_distinct(
            F.flatten(F.transform("strings", lambda s: alarm_codes(s))))).alias("effective"))
    listed = seg.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(
        "seg_index", "state", iso("start").alias("start"), iso("end").alias("end"), "data_points",
        "rule_hits"))).alias("segments"))
    return overall.join(codes, "trace_id", "left").join(alarms, "trace_id", "left").join(
        listed, "trace_id", "left")


def gather(cases: DataFrame, frames: DataFrame, images: DataFrame) -> DataFrame:
    """Cases with data, text and vision evidence merged; one row per case."""
    # One row per case and one per photo; several branches read them.
    cases = materialise(C.engineer_text(C.default_windows(cases)))
    images = materialise(images)
    data = analyse_telemetry(cases, frames)
    seen = vision.status(cases, images, vision.findings(images))
    texts = vision.summaries(vision.with_notes(images)).withColumnRenamed("summary", "vision_summary")
    merged = C.merge_evidence(cases, data, seen, texts)
    empty = F.array().cast("array<string>")
    return C.coverage(merged).withColumns({
        "flags": F.coalesce("flags", empty), "effective": F.coalesce("effective", empty),
        "last": F.coalesce("last", empty),
        # Eight window figures plus seventeen per segment, as far as they have values.
        "n_measurements": F.when(F.col("total_points") > 0, 8).otherwise(0),
        "n_descriptions": F.when(F.col("total_points") > 0, F.greatest(F.size("flags"), F.lit(1)))
        .otherwise(0)})


def diagnose(cases: DataFrame, frames: DataFrame, images: DataFrame,
             clauses: DataFrame | None = None, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Evidence, manual passages, attribution, verdict, protected actions and delivery."""
    evidence = gather(cases, frames, images)
    informed = manual.builtin_topics(evidence) if clauses is None \
        else manual.clause_evidence(evidence, clauses)
    verdicts = safety.evaluate(attribution.attribute(informed), config)
    # One row per case: written out so that exploding its lists does not repeat the verdict logic.
    return materialise(delivery.deliver(safety.protect_actions(verdicts), F.col("reported_at")))
