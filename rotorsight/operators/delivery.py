"""Evidence chain, content hash, dispatch address, human reviews, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import limits as L
from ..functions.scalars import canonical_sha256, evidence_ref, iso


def _filled(value: Column, default: Column | str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(default)


def evidence_chain() -> Column:
    """Thresholds, vision findings, manual passages and verdict rules, in that order."""
    window = F.concat(F.lit("data.threshold_flags @ "), "start_time", F.lit("~"), "end_time")
    return F.concat(
        F.transform("flags", lambda c: evidence_ref("THRESHOLD", c, window)),
        F.transform("findings", lambda f, i: evidence_ref(
            "VISION", _filled(f["image_id"], F.concat(F.lit("img_"), i.cast("string"))),
            _filled(f["location"], "pump_body"))),
        F.transform("evidences", lambda e: evidence_ref(
            "MANUAL", F.concat(e["doc_id"], F.lit("#"), e["chunk_id"]),
            F.concat(F.lit("page "), e["page"].cast("string"), F.lit(" · "), e["section"]))),
        F.transform("rule_hits", lambda c: evidence_ref("RULE", c, "verdict rules")))


def deliver(verdicts: DataFrame, diagnosed_at: Column | None = None) -> DataFrame:
    """Add ``traceability``, ``report_sha256``, ``report_uri`` and ``diagnosed_at``."""
    kinds = F.create_map(*[F.lit(x) for kv in L.DISPATCH_TYPES.items() for x in kv])
    kind = F.coalesce(F.element_at(kinds, F.col("decision")), F.lit("general_order"))
    digest = canonical_sha256(*[F.col(c).alias(c) for c in (
        "decision", "device_id", "failure_mode", "input_hash", "reasons", "risk_level",
        "rule_hits", "rule_version", "trace_id", "traceability")])
    return (verdicts.withColumn("traceability", evidence_chain())
            .withColumn("report_sha256", digest)
            .withColumn("report_uri", F.concat(
                F.lit("dispatch://"), kind, F.lit("/"), "device_id", F.lit("/"), "trace_id",
                F.lit("?sha256="), "report_sha256"))
            .withColumn("diagnosed_at", diagnosed_at if diagnosed_at is not None
                        else F.current_timestamp()))


def chain_rows(deliveries: DataFrame) -> DataFrame:
    return deliveries.select("trace_id", F.posexplode("traceability").alias("pos", "ref")) \
        .select("trace_id", "pos", "ref.*")


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Reviews are only ever appended; nothing is overwritten."""
    reviews.select("trace_id", "decision", "reviewer", "reviewed_at", "comment") \
        .write.mode("append").parquet(path)


def latest_reviews(reviews: DataFrame, key: str = "trace_id") -> DataFrame:
    """Newest review per case plus the number of reviews (partial aggregates)."""
    newest = F.max(F.struct("reviewed_at", "reviewer", "decision"))
    return reviews.groupBy(key).agg(newest.alias("r"), F.count(F.lit(1)).alias("reviews")) \
        .select(key, "r.decision", "r.reviewer", "r.reviewed_at", "reviews")


def _cell(value: Column) -> Column:
    """Text of a table cell: bars escaped, line breaks as spaces."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _general(value: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros."""
    text = F.format_string("%.6g", value.cast("double"))
    bare = F.regexp_replace(text, r"(\.\d*?)0+(?=e|$)", "$1")
    return F.regexp_replace(bare, r"\.(?=e|$)", "")


def report_lines(deliveries: DataFrame, mode: str = "batch") -> DataFrame:
    """Report text per case as ordered lines; cases without a verdict are refused.

    ``deliveries`` is the result of ``diagnosis.diagnose``. The hashes of photos are part of the
    image table (``read_images``); telemetry and manuals are tables here, not single files.
    """
    checked = deliveries.withColumn("decision", F.when(
        F.col("decision").isNull(), F.raise_error(F.lit("a report needs a verdict")))
        .otherwise(F.col("decision")))
    text = lambda *parts: F.concat(*[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    when = lambda c: F.coalesce(iso(c), F.lit(""))
    figures = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), text(
        f"| {c} | ", _general(F.col(c)), f" | {unit} |")) for c, unit in L.OVERALL_UNITS.items()]))
    phases = F.transform(F.coalesce("segments", F.array()), lambda s: F.concat(
        F.lit("| "), s["state"], F.lit(" | "), s["start"], F.lit(" | "), s["end"], F.lit(" | "),
        s["data_points"].cast("string"), F.lit(" | "), _cell(F.array_join(s["rule_hits"], ", ")),
        F.lit(" |")))
    passages = F.flatten(F.transform("evidences", lambda e: F.array(
        F.concat(F.lit("### "), e["doc_id"], F.lit(" / "), e["chunk_id"]), F.lit(""),
        F.concat(F.lit("位置："), e["section"], F.lit("；检索方式："), e["channel"],
                 F.lit("；匹配词覆盖率："), F.format_string("%.2f", e["score"].cast("double")),
                 F.lit("。")), F.lit(""), F.coalesce(e["quote"], F.lit("")), F.lit(""))))
    lines = F.concat(
        F.array(F.lit("# 离心泵诊断报告"), F.lit(""), text("- 诊断编号：`", col("trace_id"), "`"),
                text("- 设备：`", col("device_id"), "`"),
                text("- 数据窗口：", col("start_time"), " ～ ", col("end_time"), "（案例时间为 UTC）"),
                text("- 报告生成时间：", when("diagnosed_at"), "（UTC）"),
                F.lit(f"- 运行模式：`{mode}`"), F.lit(""), F.lit("## 结论"), F.lit(""),
                text("安全裁决：**", col("decision"), "**；风险等级：**", col("risk_level"), "**。"),
                text("故障模式：`", col("failure_mode"), "`。"), F.lit(""),
                F.lit("故障模式是基于现有证据的候选判断，润滑失效、疲劳损伤等具体根因仍须停机检查确认。"),
                F.lit(""), F.lit("## 输入与执行情况"), F.lit(""),
                text("工程师描述：", col("user_query")), F.lit(""),
                F.lit("| 环节 | 结果 |"), F.lit("|---|---|"),
                text("| 工程师文本 | ", col("text_status"), " |"),
                text("| 时序分析 | ", col("data_status"), "，", col("total_points"), " 点；",
                     _cell(F.col("data_reason")), " |"),
                text("| 视觉分析 | ", col("vision_status"), "；", _cell(F.col("vision_summary")), " |"),
                text("| 规程检索 | ", col("manual_status"), "，",
                     F.size("evidences").cast("string"), " 条 |"),
                text("| 综合归因 | ", _cell(F.col("summary")), " |"), F.lit(""),
                F.lit("## 窗口统计"), F.lit(""), F.lit("| 指标 | 数值 | 单位 |"),
                F.lit("|---|---:|---|")), figures,
        F.array(F.lit(""), F.lit("## 分段与规则"), F.lit(""),
                F.lit("| 阶段 | 开始 | 结束 | 点数 | 命中规则 |"), F.lit("|---|---|---|---:|---|")),
        phases, F.array(F.lit(""), F.lit("安全门禁判定理由："), F.lit("")),
        F.transform("reasons", lambda r: F.concat(F.lit("- "), r)),
        F.array(F.lit(""), F.lit("## 规程证据"), F.lit("")), passages,
        F.when(F.size("evidences") == 0, F.array(F.lit("未检索到规程证据。"), F.lit(""))).otherwise(
            F.array().cast("array<string>")),
        F.array(F.lit("## 安全处置与后续核验"), F.lit("")),
        F.transform("actions", lambda a, i: F.concat(
            (i + 1).cast("string"), F.lit(". ["), a["priority"], F.lit("] "), a["action"],
            F.lit("（依据：`"), a["source_ref"]["id"], F.lit("`）"))),
        F.array(F.lit(""), F.lit("上述为诊断建议；本次运行未连接控制系统，也未实际停机或下发工单。"), F.lit(""),
                F.lit("## 溯源与完整性"), F.lit(""),
                text("- 规则版本：`", col("rule_version"), "`"),
                text("- 门禁输入 SHA-256：`", col("input_hash"), "`"),
                text("- 裁决与证据链 SHA-256：`", col("report_sha256"), "`（不代表整份 Markdown 文件哈希）"),
                text("- 逻辑交付地址：`", col("report_uri"), "`"), F.lit("")),
        F.transform("traceability", lambda r: F.concat(
            F.lit("- "), r["kind"], F.lit(": `"), r["id"], F.lit("` — "), r["locator"])))
    return checked.select("trace_id", lines.alias("lines"))


def write_reports(deliveries: DataFrame, path: str) -> None:
    """A Markdown document per case (a folder named by the case) and the full state as JSON."""
    report_lines(deliveries).select("trace_id", F.array_join("lines", "\n").alias("value")) \
        .write.mode("overwrite").partitionBy("trace_id").text(f"{path}/markdown")
    deliveries.write.mode("overwrite").json(f"{path}/state")
