"""Findings, status and texts from supplied image observations.

An image row is (trace_id, pos, image_id, uri, description, limitations[], observations[]), an
observation (target, finding, polarity, defect_type, severity, confidence, evidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import limits as L
from ..functions.scalars import confidence_band, strip, tail_name

OBSERVATION = ("struct<target:string,finding:string,polarity:string,defect_type:string,"
               "severity:string,confidence:double,evidence:string>")


def image_refs(cases: DataFrame) -> DataFrame:
    """One row per image reference of a case, with its position."""
    return cases.select("trace_id", F.posexplode("image_refs").alias("pos", "ref")) \
        .select("trace_id", "pos", "ref.*")


def attach_results(refs: DataFrame, results: DataFrame) -> DataFrame:
    """References zipped with analysis results by position; a missing result is a failed image."""
    failed = F.concat(F.lit(L.FAILED_PREFIX), F.lit("，未产生视觉结论：no result）"))
    return refs.join(results, ["trace_id", "pos"], "left").withColumns({
        "description": F.coalesce("description", failed),
        "limitations": F.coalesce("limitations", F.array(F.lit("处理失败：no result"))),
        "observations": F.coalesce("observations", F.array().cast(f"array<{OBSERVATION}>"))})


def failed_image(error: str):
    """Description and limitation of an image that could not be processed."""
    return (F.concat(F.lit(L.FAILED_PREFIX), F.lit("，未产生视觉结论："), F.col(error), F.lit("）")),
            F.array(F.concat(F.lit("处理失败："), F.col(error))))


def _abnormal(images: DataFrame) -> DataFrame:
    rows = images.select("trace_id", "pos", "image_id",
                         F.posexplode("observations").alias("obs_pos", "o"))
    filled = lambda c: F.coalesce(strip(F.col(f"o.{c}")) != "", F.lit(False))
    return rows.filter(F.col("o.polarity") == "abnormal").withColumn(
        "complete", filled("defect_type") & filled("severity") & filled("evidence"))


def findings(images: DataFrame) -> DataFrame:
    """One row per complete abnormal observation."""
    return _abnormal(images).filter("complete").select(
        "trace_id", "pos", "obs_pos", "image_id",
        strip("o.defect_type").alias("defect_type"), F.col("o.severity").alias("severity"),
        F.col("o.target").alias("location"), confidence_band(F.col("o.confidence"))
        .alias("confidence"), strip("o.evidence").alias("evidence"))


def rejected(images: DataFrame) -> DataFrame:
    """Abnormal observations that lack a type, a severity or evidence, with the note they leave."""
    return _abnormal(images).filter("NOT complete").select(
        "trace_id", "pos", "obs_pos", "image_id", F.concat(
            F.lit("「"), "o.target",
            F.lit("」的异常缺少完整的缺陷要素（defect_type/severity/evidence），未计入 findings"))
        .alias("note"))


def with_notes(images: DataFrame) -> DataFrame:
    """Append the notes of rejected observations to the limitations. Row-local."""
    incomplete = F.filter("observations", lambda o: (o["polarity"] == "abnormal") & ~(
        F.coalesce(strip(o["defect_type"]) != "", F.lit(False))
        & F.coalesce(strip(o["severity"]) != "", F.lit(False))
        & F.coalesce(strip(o["evidence"]) != "", F.lit(False))))
    notes = F.transform(incomplete, lambda o: F.concat(
        F.lit("「"), o["target"],
        F.lit("」的异常缺少完整的缺陷要素（defect_type/severity/evidence），未计入 findings")))
    return images.withColumn("limitations", F.concat("limitations", notes))


def status(cases: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """NO_IMAGE, FAILED, DEFECT_FOUND or NO_DEFECT per case, with the findings as an array."""
    seen = images.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("images"),
        F.bool_and(F.coalesce(F.col("description").startswith(L.FAILED_PREFIX), F.lit(False)))
        .alias("all_failed"))
    item = F.struct("pos", "obs_pos", "image_id", "defect_type", "severity", "location",
                    "confidence", "evidence")
    listed = found.groupBy("trace_id").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    empty = F.array().cast(listed.schema["findings"].dataType)
    return (cases.select("trace_id").join(seen, "trace_id", "left")
            .join(listed, "trace_id", "left")
            .select("trace_id", F.coalesce("images", F.lit(0)).alias("images"),
                    F.when(F.col("images").isNull(), "NO_IMAGE").when(F.col("all_failed"), "FAILED")
                    .when(F.col("findings").isNotNull(), "DEFECT_FOUND").otherwise("NO_DEFECT")
                    .alias("vision_status"),
                    F.coalesce("findings", empty).alias("findings")))


def summaries(images: DataFrame) -> DataFrame:
    """Text per case: a block per image in order, then the list of what was not verified."""
    named = F.format_string("[图%d] %s", F.col("pos") + 1, tail_name("uri"))
    limits = F.array_join(F.filter(F.transform("limitations", lambda x: strip(x)),
                                   lambda x: x != ""), "；")
    body = strip(F.coalesce("description", F.lit("")))
    block = F.when(body != "", F.concat(named, F.lit("\n"), body, F.when(
        limits != "", F.concat(F.lit("\n本图未核验："), limits)).otherwise("")))
    line = F.when(limits != "", F.concat(F.lit("- "), named, F.lit("："), limits))
    rows = images.select("trace_id", "pos", block.alias("block"), line.alias("line"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(
        F.when(F.col(c).isNotNull(), F.struct("pos", c)))), lambda x: x[c])
    joined = rows.groupBy("trace_id").agg(ordered("block").alias("blocks"),
                                          ordered("line").alias("lines"))
    tail = F.when(F.size("lines") > 0, F.concat(F.lit("未核验汇总：\n"), F.array_join("lines", "\n")))
    text = F.when(F.size("blocks") > 0, F.array_join("blocks", "\n\n"))
    return joined.select("trace_id", F.concat_ws("\n\n", text, tail).alias("summary"))
