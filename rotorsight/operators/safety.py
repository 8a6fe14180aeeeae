"""Deterministic verdict per case: trips, sufficiency, conflicts, risk, decision, actions.

One row per ``trace_id`` in, one row out. Everything is row-local CASE logic over literals from
the risk configuration, so the verdict adds no shuffle to the plan that feeds it.

Input columns: device_id, user_query, data_status, flags[], max_temp_de, max_vib_de, max_vib_nde,
min_press_in, avg_flow (nullable), n_measurements, n_descriptions, text_status, text,
vision_status, findings[], proposal_mode (nullable), confidence, evidence_sources[], conflicts[],
insufficient, degraded_steps[].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import limits as L
from ..functions.scalars import (at_least, below, canonical_sha256, evidence_ref,
                                 text_array)
from ..sources.config import RiskConfig
from .attribution import any_flag, has_finding, is_leak

SEVERE_LEAK = "RULE_SEVERE_LEAK_TRIP"
LEVELS = {name: rank for rank, name in enumerate(L.RISK_LEVELS)}


def _flag(code: str) -> Column:
    return F.coalesce(F.array_contains("flags", code), F.lit(False))


def _lookup(pairs: dict[str, str], key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.element_at(table, key), default)


def critical_trips(config: RiskConfig) -> tuple[Column, Column]:
    """Trip codes and their reasons, in order: rule flags, measured values, severe leak."""
    labels = {c: lab for c, lab, _, _ in L.RULE_CATALOG}
    sources = {c: src for c, _, src, _ in L.RULE_CATALOG}
    flagged = F.array_sort(F.array_distinct(
        F.array_intersect("flags", text_array(config.trip_rules))))
    flag_reasons = F.transform(flagged, lambda c: F.concat(
        F.lit("触发紧急停机线/急剧恶化判据【"), c, F.lit("】: "), _lookup(labels, c, c),
        F.lit(" (依据: "), _lookup(sources, c, F.lit(L.RULE_SOURCE_DEFAULT)), F.lit(")。")))
    measured = [
        ("BEARING_TEMP_DE_TRIP", "max_temp_de", at_least("max_temp_de", L.TEMP_TRIP),
         "实测驱动端最高温度 %.1f℃ 越过停机线 (80.0℃)，强制停机拦截。"),
        ("VIB_DE_TRIP", "max_vib_de", at_least("max_vib_de", L.VIB_TRIP),
         "实测驱动端最高振动 %.2fmm/s 越过停机线 (4.5mm/s)，强制停机拦截。"),
        ("VIB_NDE_TRIP", "max_vib_nde", at_least("max_vib_nde", L.VIB_TRIP),
         "实测非驱动端最高振动 %.2fmm/s 越过停机线 (4.5mm/s)，强制停机拦截。"),
        ("PRESS_IN_TRIP", "min_press_in",
         F.coalesce(F.col("min_press_in") <= L.PRESS_IN_TRIP, F.lit(False)),
         "实测入口吸上压力 %.3fMPa 低于脱流停机线 (-0.055MPa)，气蚀毁泵先兆。"),
    ]
    new = lambda code, test: test & ~(_flag(code) & F.lit(code in config.trip_rules))
    codes = [F.when(new(code, test), code) for code, _, test, _ in measured]
    reasons = [F.when(new(code, test), F.format_string(text, F.col(value).cast("double")))
               for code, value, test, text in measured]
    severe = F.filter("findings", lambda f: is_leak(f) & (F.upper(f["severity"]) == "SEVERE"))
    leaking = F.size(severe) > 0
    leak_reason = F.when(leaking, F.concat(
        F.lit("视觉检出严重介质喷淋泄漏 ("), F.get(severe, F.lit(0))["location"],
        F.lit(")，触发一级安全阻断。")))
    return (F.concat(flagged, F.array_compact(F.array(*codes, F.when(leaking, SEVERE_LEAK)))),
            F.concat(flag_reasons, F.array_compact(F.array(*reasons, leak_reason))))


def sufficiency() -> tuple[Column, Column, Column]:
    """(insufficient, codes, reasons) from the status of the inputs and the declared sources."""
    failed = (F.col("data_status") == "FAILED") | (F.col("vision_status") == "FAILED")
    no_data = (F.col("data_status").isin("EMPTY", "PENDING") & (F.size("flags") == 0)
               & (F.col("n_descriptions") == 0) & (F.col("n_measurements") == 0))
    no_image = F.col("vision_status").isin("NO_IMAGE", "PENDING") & (F.size("findings") == 0)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    no_text = F.col("text_status").isin("EMPTY", "PENDING") | (blank("text") & blank("user_query"))
    empty = no_data & no_image & no_text
    stop = failed | empty
    claims = lambda source: F.array_contains("evidence_sources", source)
    false_data = ~stop & claims("DATA") & (F.col("data_status") == "EMPTY")
    false_image = ~stop & claims("VISION") & (F.col("vision_status") == "NO_IMAGE")
    partial = ~stop & (F.col("data_status") == "PARTIAL")
    unsure = F.col("confidence").isin("LOW", "UNKNOWN")
    codes = F.array_compact(F.array(
        F.when(failed, "RULE_EVIDENCE_FAILURE_GUARD").when(empty, "RULE_EMPTY_INPUT_GUARD"),
        F.when(false_data | false_image, "RULE_INPUT_HALLUCINATION_GUARD"),
        F.when(partial, "RULE_DATA_PARTIAL_GUARD")))
    reasons = F.array_compact(F.array(
        F.when(failed, L.REASON_FAILED).when(empty, L.REASON_EMPTY),
        F.when(false_data, L.REASON_NO_DATA), F.when(false_image, L.REASON_NO_IMAGE),
        F.when(partial & unsure, L.REASON_PARTIAL)))
    return stop, codes, reasons


def high_risk_device(config: RiskConfig) -> Column:
    """Any pattern is a case-insensitive substring of the device id."""
    device = F.upper(F.trim(F.coalesce("device_id", F.lit(""))))
    hit = F.lit(False)
    for pattern in config.high_risk_devices:
        hit = hit | F.contains(device, F.lit(pattern.upper()))
    return hit & (device != "")


def conflicts() -> tuple[Column, Column]:
    """(has conflict, reasons). Only the first kind of conflict that applies gives reasons."""
    reported = F.size("conflicts") > 0
    red = F.array_sort(F.array_intersect("flags", text_array(L.RED_LINE_CODES)))
    unseen = (F.size(red) > 0) & (F.col("vision_status") == "NO_DEFECT")
    starved = _flag("CURRENT_HIGH") & (below("avg_flow", L.FLOW_WARN_LOW) | _flag("PRESS_IN_LOW"))
    unseen_reason = F.concat(
        F.lit("物理证据严重矛盾: 时序触发红线告警 ['"), F.array_join(red, "', '"),
        F.lit("']，但现场图片判定为无缺陷完好，需人工排查传感器真伪。"))
    reasons = (F.when(reported, F.transform("conflicts", lambda c: F.concat(
        F.lit("归因引擎检出跨模态冲突: "), c)))
        .when(unseen, F.array(unseen_reason)).when(starved, F.array(F.lit(L.REASON_HYDRAULIC)))
        .otherwise(F.array().cast("array<string>")))
    return reported | unseen | starved, reasons


def failure_mode() -> Column:
    leak = has_finding(lambda f: is_leak(f) & F.upper(f["severity"]).isin("MODERATE", "SEVERE"))
    return (F.when(any_flag(L.BEARING_CODES), "BEARING_DEGRADATION")
            .when(any_flag(L.CAVITATION_CODES), "CAVITATION").when(leak, "SEAL_LEAK")
            .when(_flag("CURRENT_HIGH"), "MOTOR_OVERLOAD")
            .when(F.col("proposal_mode").isNotNull() & ~F.col("insufficient"),
                  F.col("proposal_mode"))
            .when(F.size("evidence_sources") == 0, "INSUFFICIENT_EVIDENCE").otherwise("NORMAL"))


def risk_rank(config: RiskConfig) -> Column:
    """Rank of the risk level from rule facts, raised to the failure mode's base level."""
    serious = has_finding(lambda f: F.upper(f["severity"]).isin("SEVERE", "MODERATE"))
    minor = has_finding(lambda f: F.upper(f["severity"]) == "MINOR")
    facts = (F.when(any_flag(config.warn_rules) | serious | F.col("has_conflict"), LEVELS["HIGH"])
             .when(minor | any_flag(L.DRIFT_CODES) | (F.col("data_status") == "PARTIAL"),
                   LEVELS["MEDIUM"]).otherwise(LEVELS["LOW"]))
    if config.failure_mode_risk:
        ranks = {k: LEVELS[v] for k, v in config.failure_mode_risk.items()}
        base = _lookup(ranks, F.col("failure_mode"), F.lit(LEVELS["LOW"]))
    else:
        base = F.lit(LEVELS["LOW"])
    return F.when(F.col("trip"), LEVELS["CRITICAL"]).otherwise(F.greatest(facts, base))


def decision() -> Column:
    level = F.col("risk_level")
    unsure = (F.col("data_status") == "PARTIAL") & F.col("confidence").isin("LOW", "UNKNOWN")
    clear = (F.col("confidence") == "HIGH") & (F.size("degraded_steps") == 0)
    return (F.when(level == "CRITICAL", "BLOCK").when(F.col("stop"), "INSUFFICIENT_DATA")
            .when(F.col("high_risk") | F.col("has_conflict") | F.col("hallucination") | unsure
                  | (level == "HIGH"), "MANUAL_REVIEW")
            .when(level == "MEDIUM", F.when(clear, "PASS").otherwise("MANUAL_REVIEW"))
            .when(level == "LOW", "PASS").otherwise("MANUAL_REVIEW"))


HASHED_INPUT = ["conflicts", "confidence", "data_status", "degraded_steps", "device_id",
                "evidence_sources", "findings", "flags", "insufficient", "n_descriptions",
                "n_measurements", "proposal_mode", "text", "text_status", "vision_status"]
HASHED_NUMBERS = ["avg_flow", "max_temp_de", "max_vib_de", "max_vib_nde", "min_press_in"]


def input_hash(config: RiskConfig) -> Column:
    """SHA-256 of everything the verdict reads, fields in name order, numbers at nine digits."""
    fields = {c: F.col(c) for c in HASHED_INPUT}
    fields |= {c: F.round(F.col(c), 9) for c in HASHED_NUMBERS}
    fields["rule_version"] = F.lit(config.version)
    return canonical_sha256(*[fields[c].alias(c) for c in sorted(fields)])


def evaluate(cases: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Add decision, risk_level, failure_mode, rule_hits, reasons, rule_version and input_hash."""
    trip_codes, trip_reasons = critical_trips(config)
    stop, data_codes, data_reasons = sufficiency()
    conflict, conflict_reasons = conflicts()
    staged = cases.withColumns({
        "trip_codes": trip_codes, "trip_reasons": trip_reasons, "stop": F.coalesce(stop, F.lit(False)),
        "data_codes": data_codes, "data_reasons": data_reasons,
        "high_risk": high_risk_device(config), "has_conflict": F.coalesce(conflict, F.lit(False)),
        "conflict_reasons": conflict_reasons, "failure_mode": failure_mode()}).withColumns({
            "trip": F.size("trip_codes") > 0,
            "hallucination": F.array_contains("data_codes", "RULE_INPUT_HALLUCINATION_GUARD")})
    ranked = staged.withColumn("risk_level", F.element_at(
        text_array(L.RISK_LEVELS), risk_rank(config) + 1))
    guard = F.when(F.col("high_risk"), "RULE_HIGH_RISK_DEVICE_GUARD")
    guard_reason = F.when(F.col("high_risk"), F.concat(
        F.lit("设备【"), "device_id",
        F.lit("】属于高危/核心主干管网保护名单，系统剥夺自动放行权限，锁定为人工复核签审。")))
    hits = F.concat("trip_codes", "data_codes", F.array_compact(F.array(
        guard, F.when(F.col("has_conflict"), "RULE_EVIDENCE_CONFLICT"))))
    reasons = F.concat("trip_reasons", "data_reasons", F.array_compact(F.array(guard_reason)),
                       "conflict_reasons")
    return ranked.withColumns({
        "decision": decision(), "rule_hits": F.array_sort(F.array_distinct(hits)),
        "reasons": F.when(F.size(reasons) == 0, F.array(F.lit(L.REASON_GREEN)))
        .otherwise(reasons),
        "rule_version": F.lit(config.version), "input_hash": input_hash(config)}).drop(
        "trip_codes", "trip_reasons", "stop", "data_codes", "data_reasons", "conflict_reasons",
        "trip", "hallucination", "high_risk", "has_conflict")


def protect_actions(verdicts: DataFrame) -> DataFrame:
    """Replace ``actions`` by what the decision allows.

    BLOCK and INSUFFICIENT_DATA discard the existing actions, MANUAL_REVIEW puts the review guard
    in front of them, PASS leaves them.
    """
    guards = {}
    for verdict, _, action, priority, ident in L.GUARD_ACTIONS:
        guards.setdefault(verdict, []).append(F.struct(
            F.lit(action).alias("action"), F.lit(priority).alias("priority"),
            evidence_ref("RULE", ident, "verdict rules").alias("source_ref")))
    typed = lambda v: F.array(*guards[v])
    return verdicts.withColumn(
        "actions", F.when(F.col("decision") == "BLOCK", typed("BLOCK"))
        .when(F.col("decision") == "INSUFFICIENT_DATA", typed("INSUFFICIENT_DATA"))
        .when(F.col("decision") == "MANUAL_REVIEW", F.concat(typed("MANUAL_REVIEW"), "actions"))
        .otherwise(F.col("actions")))


def with_service_level(verdicts: DataFrame, matrix: DataFrame) -> DataFrame:
    """Attach name, response hours and default decision of the risk level (four rows)."""
    return verdicts.join(F.broadcast(matrix), F.col("risk_level") == F.col("level"), "left") \
        .drop("level")
