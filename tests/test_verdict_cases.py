"""Verdict, actions and delivery on the published unit cases, plus replay."""

import pytest
from pyspark.sql import functions as F

from rotorsight import limits as L
from rotorsight.operators import attribution, delivery, manual, safety
from rotorsight.sources.config import RiskConfig

FINDING = ("struct<pos:int,obs_pos:int,image_id:string,defect_type:string,severity:string,"
           "location:string,confidence:string,evidence:string>")
SCHEMA = f"""trace_id string, device_id string, user_query string, alarm_code string, start_time string,
 end_time string, data_status string, data_reason string, total_points long, flags array<string>,
 max_temp_de double, max_vib_de double, max_vib_nde double, min_press_in double, avg_flow double,
 n_measurements int, n_descriptions int, text_status string, text string, vision_status string,
 findings array<{FINDING}>, proposal_mode string, confidence string, evidence_sources array<string>,
 conflicts array<string>, insufficient boolean, degraded_steps array<string>"""
BASE = dict(device_id="PUMP-IS100-80-160-01", user_query="", alarm_code=None, start_time="", end_time="",
            data_status="OK", data_reason="", total_points=120, flags=[], max_temp_de=None,
            max_vib_de=None, max_vib_nde=None, min_press_in=None, avg_flow=None, n_measurements=2,
            n_descriptions=0, text_status="PENDING", text="", vision_status="PENDING", findings=[],
            proposal_mode="NORMAL", confidence="HIGH", evidence_sources=["DATA"], conflicts=[],
            insufficient=False, degraded_steps=[])
EMPTY = dict(n_measurements=0, total_points=0, proposal_mode=None, confidence="UNKNOWN",
             evidence_sources=[])
LEAK = dict(pos=0, obs_pos=0, image_id="i1", defect_type="leak", location="seal", confidence="HIGH",
            evidence="e")
CASES = {
    "trip": dict(flags=["BEARING_TEMP_DE_TRIP", "VIB_DE_TRIP"], max_temp_de=84.5, max_vib_de=4.8),
    "blacklist": dict(device_id="pump-a01-heavy-oil", max_temp_de=45.0, vision_status="NO_DEFECT",
                      evidence_sources=["DATA", "VISION"]),
    "empty": dict(EMPTY, data_status="PENDING"),
    "conflict": dict(flags=["BEARING_TEMP_DE_TRIP"], max_temp_de=82.0, vision_status="NO_DEFECT",
                     proposal_mode="BEARING_DEGRADATION", confidence="MEDIUM", conflicts=["x"]),
    "hallucination": dict(data_status="EMPTY", n_measurements=0, text_status="RECORDED",
                          text="巡检发现声音异常", proposal_mode="BEARING_DEGRADATION",
                          evidence_sources=["DATA", "ENGINEER_TEXT"]),
    "pass": dict(max_temp_de=45.0, max_vib_de=1.1, vision_status="NO_DEFECT",
                 evidence_sources=["DATA", "VISION"]),
    "failed": dict(data_status="FAILED"),
    "exactly_on_limit": dict(max_vib_de=4.5),
    "press_trip": dict(min_press_in=-0.0551),
    "severe_leak": dict(vision_status="DEFECT_FOUND", findings=[dict(LEAK, severity="SEVERE")]),
    "minor": dict(vision_status="DEFECT_FOUND", findings=[dict(LEAK, severity="MINOR")]),
    "minor_degraded": dict(vision_status="DEFECT_FOUND", degraded_steps=["vision"],
                           findings=[dict(LEAK, severity="MINOR")]),
    "overload": dict(flags=["CURRENT_HIGH"], avg_flow=84.9),
    "partial_unsure": dict(data_status="PARTIAL", confidence="LOW"),
    "partial_sure": dict(data_status="PARTIAL"),
}
EXPECTED = {   # decision, risk, failure mode, a rule that must be hit
    "trip": ("BLOCK", "CRITICAL", "BEARING_DEGRADATION", "VIB_DE_TRIP"),
    "blacklist": ("MANUAL_REVIEW", "LOW", "NORMAL", "RULE_HIGH_RISK_DEVICE_GUARD"),
    "empty": ("INSUFFICIENT_DATA", "MEDIUM", "INSUFFICIENT_EVIDENCE", "RULE_EMPTY_INPUT_GUARD"),
    "conflict": ("BLOCK", "CRITICAL", "BEARING_DEGRADATION", "RULE_EVIDENCE_CONFLICT"),
    "hallucination": ("MANUAL_REVIEW", "HIGH", "BEARING_DEGRADATION",
                      "RULE_INPUT_HALLUCINATION_GUARD"),
    "pass": ("PASS", "LOW", "NORMAL", None),
    "failed": ("INSUFFICIENT_DATA", "LOW", "NORMAL", "RULE_EVIDENCE_FAILURE_GUARD"),
    "exactly_on_limit": ("BLOCK", "CRITICAL", "NORMAL", "VIB_DE_TRIP"),
    "press_trip": ("BLOCK", "CRITICAL", "NORMAL", "PRESS_IN_TRIP"),
    "severe_leak": ("BLOCK", "CRITICAL", "SEAL_LEAK", "RULE_SEVERE_LEAK_TRIP"),
    "minor": ("PASS", "MEDIUM", "NORMAL", None),
    "minor_degraded": ("MANUAL_REVIEW", "MEDIUM", "NORMAL", None),
    "overload": ("MANUAL_REVIEW", "HIGH", "MOTOR_OVERLOAD", "RULE_EVIDENCE_CONFLICT"),
    "partial_unsure": ("MANUAL_REVIEW", "MEDIUM", "NORMAL", "RULE_DATA_PARTIAL_GUARD"),
    "partial_sure": ("PASS", "MEDIUM", "NORMAL", "RULE_DATA_PARTIAL_GUARD"),
}


def case_frame(spark, cases):
    columns = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(", ")]
    rows = [dict(BASE, trace_id=name, **values) for name, values in cases.items()]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def verdicts(spark):
    frame = manual.builtin_topics(case_frame(spark, CASES))
    done = delivery.deliver(safety.protect_actions(safety.evaluate(frame)),
                            F.lit("2026-01-01").cast("timestamp"))
    return {r.trace_id: r for r in done.collect()}


@pytest.mark.parametrize("name", CASES)
def test_decision(verdicts, name):
    row, (decision, risk, mode, rule) = verdicts[name], EXPECTED[name]
    assert (row.decision, row.risk_level, row.failure_mode) == (decision, risk, mode)
    assert rule is None or rule in row.rule_hits
    assert row.rule_hits == sorted(set(row.rule_hits)) and row.reasons


def test_actions_and_dispatch(verdicts):
    assert "紧急切机停运" in verdicts["trip"].actions[0].action
    assert len(verdicts["trip"].actions) == 2
    assert "人工复核卡点" in verdicts["blacklist"].actions[0].action
    assert len(verdicts["blacklist"].actions) == 2     # guard plus the fallback topic
    assert all("数据复勘任务" in a.action for a in verdicts["empty"].actions)
    assert verdicts["trip"].report_uri.startswith("dispatch://emergency_shutdown/PUMP-IS100")
    assert "resurvey_checklist" in verdicts["empty"].report_uri
    assert [t.kind for t in verdicts["severe_leak"].traceability] == ["VISION", "MANUAL", "RULE"]
    assert verdicts["pass"].reasons == [L.REASON_GREEN]


def test_replay_gives_the_same_hashes(spark, verdicts):
    shuffled = case_frame(spark, dict(reversed(CASES.items()))).repartition(7)
    again = safety.evaluate(manual.builtin_topics(shuffled)).collect()
    assert {r.trace_id: r.input_hash for r in again} == {
        k: v.input_hash for k, v in verdicts.items()}
    changed = safety.evaluate(manual.builtin_topics(
        case_frame(spark, {"trip": dict(CASES["trip"], max_temp_de=84.6)}))).first()
    assert changed.input_hash != verdicts["trip"].input_hash


def test_given_proposals_are_kept(spark):
    cases = manual.builtin_topics(case_frame(spark, {"a": {}, "b": {}})).withColumns({
        "given_mode": F.when(F.col("trace_id") == "a", "CAVITATION"),
        "given_confidence": F.lit("LOW")})
    rows = {r.trace_id: r for r in attribution.attribute(cases).collect()}
    assert (rows["a"].proposal_mode, rows["a"].confidence) == ("CAVITATION", "LOW")
    assert rows["b"].proposal_mode == "NORMAL"


def test_vocabularies_agree():
    codes = {c for c, *_ in L.RULE_CATALOG}
    assert codes == set(L.RULE_ORDER) and len(codes) == 17
    assert set(RiskConfig().failure_mode_risk) == set(L.FAILURE_MODES) == set(L.FAILURE_MODE_LABELS)
    assert set(RiskConfig().trip_rules) - codes == {"PRESS_IN_TRIP"}
