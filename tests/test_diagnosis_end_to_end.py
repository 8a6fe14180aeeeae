"""The bearing case from frames and clauses to report, and the smaller operators around it."""

import pandas as pd
from pyspark.sql import functions as F

from rotorsight.operators import cases, delivery, measures, retrieval, rules, vision
from rotorsight.operators.segments import overall_metrics, segment_metrics, telemetry_runs
from rotorsight.plans import diagnosis, standin
from rotorsight.sources.documents import read_images
from test_golden_case import golden_frames

CASE = ("t1", "PUMP-DEMO-BEARING-01", "2026-11-17T00:00:00", "2026-11-17T00:30:00",
        "驱动端轴承逐渐发热并伴随振动升高，请排查。", None, [], None)
CASE_SCHEMA = ("trace_id string, device_id string, start_time string, end_time string, "
               "user_query string, alarm_code string, degraded_steps array<string>, "
               "reported_at timestamp")
IMAGE_SCHEMA = ("trace_id string, pos int, image_id string, uri string, description string, "
                f"limitations array<string>, observations array<{vision.OBSERVATION}>")


def test_bearing_case(spark, tmp_path):
    one = spark.createDataFrame([CASE], CASE_SCHEMA)
    images = spark.createDataFrame([], IMAGE_SCHEMA)
    done = diagnosis.diagnose(one, golden_frames(spark), images, standin.clauses(spark))
    row = done.first()
    assert (row.data_status, row.total_points, row.vision_status) == ("OK", 361, "NO_IMAGE")
    assert row.flags == ["BEARING_TEMP_DE_TRIP", "BEARING_TEMP_DE_RAMP_SHARP", "VIB_DE_TRIP",
                         "VIB_DE_DOMINANT"]
    assert [(e.chunk_id, e.score) for e in row.evidences] == [("bearing-01", 0.6)]
    assert (row.decision, row.risk_level, row.failure_mode) == (
        "BLOCK", "CRITICAL", "BEARING_DEGRADATION")
    assert row.evidence_sources == ["DATA", "MANUAL", "ENGINEER_TEXT"]
    assert row.summary == "综合【DATA, MANUAL, ENGINEER_TEXT】得出初步判断：驱动端轴承干摩擦或疲劳劣化。"
    assert len(row.actions) == 2
    assert [t.kind for t in row.traceability] == ["THRESHOLD"] * 4 + ["MANUAL"] + ["RULE"] * 3
    assert row.effective == ["TAHH-101"] and row.last == ["TAHH-101"]
    lines = delivery.report_lines(done).first().lines
    assert lines[0] == "# 离心泵诊断报告" and "故障模式：`BEARING_DEGRADATION`。" in lines
    assert sum(line.startswith("- THRESHOLD: ") for line in lines) == 4
    delivery.write_reports(done, str(tmp_path))
    assert spark.read.json(str(tmp_path / "state")).first().decision == "BLOCK"
    written = spark.read.text(str(tmp_path / "markdown"), wholetext=True).collect()
    assert len(written) == 1 and written[0].value == "\n".join(lines) + "\n"
    text = written[0].value
    assert "| max_temp_de | 85.5 | ℃ |" in text and "| total_points | 361 | count |" in text
    assert "| DEGRADING | 2026-11-17T00:05:00 | 2026-11-17T00:30:00 | 301 | BEARING_TEMP_DE_TRIP, " in text
    assert f"工程师描述：{row.user_query}" in text and "匹配词覆盖率：0.60。" in text
    assert "未检索到规程证据。" not in text
    barred = done.withColumns({"evidences": F.slice("evidences", 1, 0), "summary": F.lit("a|b\nc")})
    other = delivery.report_lines(barred).first().lines
    assert "未检索到规程证据。" in other and "| 综合归因 | a\\|b c |" in other
    assert spark.range(1).select(*[delivery._general(F.lit(x)) for x in (
        100.0, 0.31234567, 1234567.0, 0.0, 45.10, 0.00001234)]).first()[:] == (
        "100", "0.312346", "1.23457e+06", "0", "45.1", "1.234e-05")


def test_views_and_texts(spark):
    runs = telemetry_runs(golden_frames(spark))
    seg = rules.judge(segment_metrics(runs))
    overall = overall_metrics(runs, seg)
    rows = measures.measurements(seg, overall, ["device_id"])
    assert rows.count() == 2 * 17 + 8 and measures.violations(rows).count() == 0
    views = measures.segment_views(seg, rows, ["device_id"]).orderBy("seg_index").collect()
    assert [v.max_temp_de for v in views] == [48.0, 85.5] and views[1].rule_hits[0].endswith("TRIP")
    text = seg.orderBy("seg_index").select(rules.segment_text().alias("t")).collect()[1].t
    assert text.startswith("◆ 阶段 [DEGRADING] 2026-11-17T00:05:00 ~ 2026-11-17T00:30:00\n    时长 1500s，301 点")
    assert "slope=1.5 ℃/min, max=85.5 ℃" in text
    whole = overall.withColumn("alarm_text", F.lit("")).select(rules.overall_text()).first()[0]
    assert "- 阶段数：2" in whole and "报警码：无" in whole and "结束状态：DEGRADING" in whole
    hits = rules.hit_rows(seg, rules.rule_catalog(spark)).filter("code LIKE '%SHARP'").first()
    assert hits.sentence == ("- [DEGRADING段 00:05:00~00:30:00] 驱动端温度急剧恶化"
                             "（BEARING_TEMP_DE_RAMP_SHARP），约从 00:05:55 开始")


def test_finished_cases_are_reused(spark):
    todo = spark.createDataFrame([("a", 1), ("b", 2)], "trace_id string, v int")
    stored = spark.createDataFrame([("a", 9)], "trace_id string, v int")
    fresh = cases.not_yet_done(todo, stored)
    assert sorted(map(tuple, cases.reuse_finished(fresh, stored).collect())) == [("a", 9), ("b", 2)]


def test_images_by_position(spark, tmp_path):
    refs = vision.image_refs(spark.createDataFrame(
        [("t", [("i0", "x/a.png", "s", ""), ("i1", "x/b.png", "s", "")])],
        "trace_id string, image_refs array<struct<image_id:string,uri:string,source:string,"
        "captured_at:string>>"))
    seen = [("t", 0, "照片", ["反光"], [("轴承", "rust", "abnormal", " LEAK ", "MINOR", 0.5, "e"),
                                        ("密封", "wet", "abnormal", "LEAK", None, 0.9, "e"),
                                        ("表", "ok", "normal", "", None, 0.0, "")])]
    results = spark.createDataFrame(seen, "trace_id string, pos int, description string, "
                                          f"limitations array<string>, observations array<{vision.OBSERVATION}>")
    images = vision.attach_results(refs, results)
    found = vision.findings(images).collect()
    assert [(f.image_id, f.defect_type, f.confidence, f.location) for f in found] == [
        ("i0", "LEAK", "MEDIUM", "轴承")]
    assert vision.rejected(images).first().note.startswith("「密封」")
    status = vision.status(refs.select("trace_id").distinct(), images, vision.findings(images)).first()
    assert (status.vision_status, status.images) == ("DEFECT_FOUND", 2)
    text = vision.summaries(vision.with_notes(images)).first().summary
    assert text.startswith("[图1] a.png\n照片\n本图未核验：反光；「密封」") and "- [图2] b.png：处理失败" in text
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n1")
    (tmp_path / "a.txt").write_bytes(b"no image")
    files = read_images(spark, str(tmp_path), 5).collect()
    assert [f.mime for f in files] == [None, "image/png"] and len(files[1].sha256) == 64


def test_reviews_and_pluggable_scorer(spark):
    schema = ("consulted boolean, error string, sufficient boolean, missing array<string>, "
              "next_queries array<string>")
    rows = [(True, "", False, ["限值"], ["q"]), (True, "", False, [], []), (True, "x", True, [], ["q"]),
            (False, "", True, [], []), (True, "", True, [], ["q"])]
    got = spark.createDataFrame(rows, schema).coalesce(1).select(
        retrieval.retry_worthy().alias("again"), retrieval.review_note().alias("note")).collect()
    assert [r.again for r in got] == [True, False, False, False, False]
    assert "缺少：限值" in got[0].note and "缺少：部分信息" in got[1].note
    assert "未经审阅" in got[2].note and got[3].note == got[4].note == ""

    @F.pandas_udf("double")
    def longer_is_better(query: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype(float)

    hits = spark.createDataFrame([(1, 0, "q", 5, 0, "ab"), (1, 0, "q", 6, 1, "abcd"),
                                  (1, 0, "q", 7, 2, "ab")],
                                 "case_id long, query_pos long, query_text string, chunk_id long, "
                                 "rank int, text string")
    best = retrieval.rerank(hits, longer_is_better("query_text", "text"), 2)
    assert [r.chunk_id for r in best.orderBy("rerank_rank").collect()] == [6, 5]
    none = retrieval.reports(hits.limit(0).withColumns({"score": F.lit(.1), "source": F.lit("s")}),
                             hits.limit(1)).first()
    assert (none.returned, none.top1, none.low_confidence) == (0, 0.0, False)
    assert spark.range(1).select(retrieval.cosine(
        F.array(F.lit(.6), F.lit(.8)), F.array(F.lit(.8), F.lit(.6)))).first()[0] == 0.96


def test_case_analysis_leaves_out_ramp_starts_and_keeps_every_rule(spark, monkeypatch):
    from rotorsight.operators import cases as C, rules, segments
    from rotorsight.plans import diagnosis, standin

    made, real = [], segments.telemetry_runs
    monkeypatch.setattr(segments, "telemetry_runs",
                        lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    frames = standin.load_telemetry(spark, "/root/testdata/sf0.001")
    cases = C.default_windows(standin.cases(frames))
    got = diagnosis.analyse_telemetry(cases, frames).select("trace_id", "flags")
    assert "ramp_time" not in made[0].columns
    whole = segments.segment_metrics(real(C.case_frames(cases, frames), C.CASE_SERIES), C.CASE_SERIES)
    assert "ramp_start_time" in whole.columns
    want = rules.window_codes(rules.judge(whole), ["trace_id"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.filter("size(flags) > 0").count() > 0
