"""Readers, checks, writers, configuration, reviews and the streaming variants."""

import json

import pytest
from pyspark.sql import functions as F

from rotorsight import limits as L
from rotorsight.functions.scalars import data_url, image_type
from rotorsight.operators import alarms, delivery
from rotorsight.plans import standin
from rotorsight.sources import config, telemetry
from rotorsight.streaming import alarms as stream
from test_golden_case import golden_frames

SF = "/root/testdata/sf0.001"


def test_csv_reader_is_strict(spark, tmp_path):
    frames = golden_frames(spark)
    path = str(tmp_path / "csv")
    frames.write.option("header", True).csv(path)
    raw = telemetry.read_csv(spark, path)
    typed = telemetry.strict_readings(raw)
    assert typed.count() == 361 and typed.schema["temp_de"].dataType.simpleString() == "double"
    window = telemetry.window(typed, "PUMP-DEMO-BEARING-01", "2026-11-17T00:00:00Z",
                              "2026-11-17T00:00:10")
    assert [r.temp_de for r in window.collect()] == [48.0, 48.0, 48.0]
    assert telemetry.window(typed, "other", "2026-11-17T00:00:00", "2026-11-18T00:00:00").count() == 0
    broken = raw.withColumn("temp_de", F.lit("warm"))
    with pytest.raises(Exception, match="not a number in temp_de"):
        telemetry.strict_readings(broken).collect()
    with pytest.raises(ValueError, match="press_in"):
        telemetry.require_columns(raw.drop("press_in"))


def test_writers(spark, tmp_path):
    frames = golden_frames(spark).withColumn("alarm_code", F.when(
        F.col("alarm_code") == "", "NONE").otherwise(F.col("alarm_code")))
    other = frames.withColumn("device_id", F.lit("P2"))
    table = str(tmp_path / "table")
    telemetry.replace_device(frames.unionByName(other), table)
    telemetry.replace_device(other.limit(10), table)
    counts = {r.device_id: r["count"] for r in spark.read.parquet(table)
              .groupBy("device_id").count().collect()}
    assert counts == {"PUMP-DEMO-BEARING-01": 361, "P2": 10}
    appended = str(tmp_path / "appended")
    telemetry.append(frames, appended)
    telemetry.append(other, appended)
    assert spark.read.parquet(appended).count() == 722
    labels = alarms.day_labels(frames, ["device_id"])
    assert labels.first().label == "seal_leak"
    telemetry.export_by_day(frames, labels, str(tmp_path / "days"))
    assert (tmp_path / "days" / "day=2026-11-17" / "label=seal_leak").is_dir()
    target = telemetry.export_full(frames, str(tmp_path))
    assert target.endswith("telemetry_full_2026-11-17_to_2026-11-17")
    assert spark.read.option("header", True).csv(target).count() == 361
    telemetry.export_by_state(frames, str(tmp_path / "states"))
    assert {p.name for p in (tmp_path / "states").glob("op*")} == {
        "operating_state=NORMAL", "operating_state=DEGRADING"}


def test_risk_config(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"version": "9", "high_risk_devices": ["X"], "trip_rules": ["T"],
                                "failure_mode_matrix": {"NORMAL": {"risk_level": "odd"},
                                                        "CAVITATION": {"risk_level": "high"}}}))
    bad.write_text("{not json")
    loaded = config.load_risk_config(spark, str(good))
    assert (loaded.version, loaded.high_risk_devices, loaded.trip_rules) == ("9", ["X"], ["T"])
    assert loaded.failure_mode_risk == {"NORMAL": "LOW", "CAVITATION": "HIGH"}
    assert loaded.warn_rules == L.MISSING_FILE_WARN_RULES
    assert config.load_risk_config(spark, str(tmp_path / "none.json")) is config.MISSING_FILE
    assert config.load_risk_config(spark, str(bad)) is config.UNREADABLE_FILE


def test_clauses_reviews_and_images(spark, tmp_path):
    path = tmp_path / "manual.json"
    path.write_text(json.dumps({"clauses": [{"doc_id": "d", "chunk_id": "c", "section": "s",
                                             "quote": "q", "keywords": ["轴承"]}]}))
    clause = config.read_clauses(spark, str(path)).first()
    assert (clause.rule_codes, clause.keywords, clause.action) == ([], ["轴承"], None)
    store = str(tmp_path / "reviews")
    schema = "trace_id string, decision string, reviewer string, reviewed_at string, comment string"
    for row in (("t", "REWORK", "a", "2026-01-01", ""), ("t", "APPROVED", "b", "2026-01-02", "")):
        delivery.append_reviews(spark.createDataFrame([row], schema), store)
    latest = delivery.latest_reviews(spark.read.parquet(store)).first()
    assert (latest.decision, latest.reviewer, latest.reviews) == ("APPROVED", "b", 2)
    blobs = {"image/png": b"\x89PNG\r\n\x1a\nxx", "image/jpeg": b"\xff\xd8\xff0", "image/gif": b"GIF89a",
             "image/webp": b"RIFF1234WEBPx", None: b"<html>"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()],
                               "want string, content binary")
    rows = df.select("want", image_type("content").alias("got"),
                     data_url("content", F.lit("image/gif")).alias("url")).collect()
    assert all(r.want == r.got for r in rows)
    assert any(r.url == "data:image/gif;base64,R0lGODlh" for r in rows)


def test_streamed_states_equal_batch_states(spark, tmp_path):
    frames = standin.load_telemetry(spark, SF).withColumn("phase_intent", F.when(
        F.col("operating_state") == "WARNING", "DEGRADING").otherwise(F.col("operating_state")))
    cut = F.col("rn") < 100
    source = str(tmp_path / "in")
    columns = ["device_id", "timestamp", "phase_intent", *L.READINGS]
    frames.filter(cut).select(columns).coalesce(1).write.mode("append").parquet(source)
    live = stream.with_states(spark.readStream.schema(frames.select(columns).schema)
                              .option("maxFilesPerTrigger", 1).parquet(source))
    query = live.writeStream.format("memory").queryName("states").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        frames.filter(~cut).select(columns).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.device_id, r.timestamp): (r.alarm, r.state) for r in spark.table("states").collect()}
    want = {(r.device_id, r.timestamp): (r.alarm, r.state)
            for r in alarms.resolve_states(frames).collect()}
    assert got == want
