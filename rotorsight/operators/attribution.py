"""Failure-mode proposal of a case from its merged evidence (row-local CASE logic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import limits as L
from ..functions.scalars import evidence_ref, text_array


def any_flag(codes) -> Column:
    return F.coalesce(F.arrays_overlap("flags", text_array(codes)), F.lit(False))


def has_finding(test) -> Column:
    return F.coalesce(F.exists("findings", test), F.lit(False))


def is_leak(finding) -> Column:
    return F.upper(finding["defect_type"]) == "LEAK"


def usable_sources() -> Column:
    """Which inputs really exist: DATA, VISION, MANUAL, ENGINEER_TEXT (in that order)."""
    data = F.col("data_status").isin("OK", "PARTIAL") & (
        (F.size("flags") > 0) | (F.col("n_measurements") > 0) | (F.col("n_descriptions") > 0))
    vision = F.col("vision_status").isin("DEFECT_FOUND", "NO_DEFECT") & (F.size("findings") > 0)
    manual = (F.col("manual_status") == "HIT") & (F.size("evidences") > 0)
    text = (F.col("text_status") == "RECORDED") & (F.trim("text") != "")
    return F.array_compact(F.array(
        F.when(data, "DATA"), F.when(vision, "VISION"), F.when(manual, "MANUAL"),
        F.when(text, "ENGINEER_TEXT")))


def label_of(mode: Column) -> Column:
    pairs = [F.lit(x) for kv in L.FAILURE_MODE_LABELS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), mode)


def threshold_ref(code) -> Column:
    return evidence_ref("THRESHOLD", code, "threshold rules")


def vision_ref(finding, index) -> Column:
    ident = F.when(F.coalesce(finding["image_id"], F.lit("")) != "", finding["image_id"]) \
        .otherwise(F.concat(F.lit("vision_finding_"), index.cast("string")))
    place = F.when(F.coalesce(finding["location"], F.lit("")) != "", finding["location"]) \
        .otherwise("pump_body")
    return evidence_ref("VISION", ident, place)


def attribute(cases: DataFrame) -> DataFrame:
    """Add proposal, confidence, sources, conflicts, support references and summary.

    Cases that already carry ``given_mode`` keep that proposal untouched.
    """
    bearing = any_flag(L.BEARING_CODES_ATTRIBUTION)
    cavitation = any_flag(L.CAVITATION_CODES)
    leak = has_finding(is_leak)
    no_source = F.size("evidence_sources") == 0
    graded = F.when(F.size("evidence_sources") >= 2, "HIGH").otherwise("MEDIUM")
    mode = (F.when(bearing, "BEARING_DEGRADATION").when(cavitation, "CAVITATION")
            .when(leak, "SEAL_LEAK").when(no_source, "INSUFFICIENT_EVIDENCE").otherwise("NORMAL"))
    confidence = (F.when(bearing | cavitation, graded).when(leak, "HIGH")
                  .when(no_source, "UNKNOWN").otherwise("MEDIUM"))
    matched = lambda codes: F.transform(
        F.array_sort(F.array_intersect("flags", text_array(codes))), threshold_ref)
    none = F.array().cast("array<struct<kind:string,id:string,locator:string>>")
    refs = (F.when(bearing, matched(L.BEARING_CODES_ATTRIBUTION))
            .when(cavitation, matched(L.CAVITATION_CODES))
            .when(leak, F.transform(F.filter("findings", is_leak), vision_ref)).otherwise(none))
    red_line = any_flag(L.RED_LINE_CODES) & (F.col("vision_status") == "NO_DEFECT")
    conflicts = F.when(red_line, F.array(F.lit(L.CONFLICT_TEXT))) \
        .otherwise(F.array().cast("array<string>"))
    listed = F.when(no_source, "无有效输入").otherwise(F.array_join("evidence_sources", ", "))
    summary = (F.when(F.col("proposal_mode") == "INSUFFICIENT_EVIDENCE",
                      F.concat(label_of(F.col("proposal_mode")), F.lit("。")))
               .when(F.col("proposal_mode") == "NORMAL", F.concat(
                   F.lit("综合【"), listed, F.lit("】，未见明显恶化异常，各项参数在允许波动范围内。")))
               .otherwise(F.concat(F.lit("综合【"), listed, F.lit("】得出初步判断："),
                                   label_of(F.col("proposal_mode")), F.lit("。"))))
    explained = F.element_at(F.create_map(
        *[F.lit(x) for kv in L.HYPOTHESIS_TEXT.items() for x in kv]), F.col("proposal_mode"))
    done = (cases.withColumn("evidence_sources", usable_sources())
            .withColumns({"proposal_mode": mode, "confidence": confidence, "support_refs": refs,
                          "conflicts": conflicts})
            .withColumns({
                "summary": summary, "hypothesis": explained,
                "insufficient": no_source
                | (F.col("proposal_mode") == "INSUFFICIENT_EVIDENCE")
                | (F.col("data_status") == "EMPTY")}))
    if "given_mode" not in cases.columns:
        return done
    given = F.col("given_mode").isNotNull()
    keep = {"proposal_mode": "given_mode", "confidence": "given_confidence",
            "evidence_sources": "given_sources", "conflicts": "given_conflicts",
            "insufficient": "given_insufficient"}
    return done.withColumns({k: F.when(given, F.col(v)).otherwise(F.col(k))
                             for k, v in keep.items() if v in cases.columns})
