"""Nulls, empty groups and limits that must not lose rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rotorsight.operators import alarms, retrieval as R, rules, runs, vision
from rotorsight.plans import diagnosis, search, standin
from rotorsight.sources import documents, telemetry
from test_golden_case import golden_frames


@pytest.mark.parametrize("seed", range(4))
def test_null_states_are_one_state(spark, seed):
    rng = random.Random(seed)
    start, rows = datetime(2026, 1, 1), []
    for key in ("a", None, "b"):
        state, at = None, start
        for _ in range(60):
            if rng.random() < 0.2:
                state = rng.choice([None, None, "ON", "OFF"])
            at += timedelta(seconds=rng.choice([5, 5, 300]))
            rows.append((key or "null-only", at, None if key is None else state))
    series = runs.Series(keys=("k",), ts="t", state="s", slice_seconds=600, block=2)
    frame = spark.createDataFrame(rows, "k string, t timestamp, s string").repartition(3)
    got = sorted((r.k, r.seg_index, r.state, r.data_points)
                 for r in runs.segments_of_states(frame, series).collect())
    want = []
    for k in sorted({r[0] for r in rows}):
        segs = []
        for _, _, s in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if segs and segs[-1][0] == s:
                segs[-1][1] += 1
            else:
                segs.append([s, 1])
        want += [(k, i, s, n) for i, (s, n) in enumerate(segs)]
    assert got == want


def test_append_and_replace_share_one_table(spark, tmp_path):
    frames = golden_frames(spark)
    later = frames.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 2 DAYS"))
    other = frames.withColumn("device_id", F.lit("P2"))
    path = str(tmp_path / "t")
    telemetry.append(frames.unionByName(other), path)
    telemetry.append(later, path)
    telemetry.replace_device(frames.limit(7), path)
    telemetry.append(other.limit(3), path)
    counts = {r.device_id: r["count"] for r in spark.read.parquet(path)
              .groupBy("device_id").count().collect()}
    assert counts == {"PUMP-DEMO-BEARING-01": 7, "P2": 364}


def test_history_is_complete_and_ascending(spark):
    frames = golden_frames(spark)
    rows = telemetry.history(frames.unionByName(frames.withColumn("device_id", F.lit("P2"))), "P2")
    times = [r.timestamp for r in rows.collect()]
    assert len(times) == 361 and times == sorted(times)


def test_unreadable_csv_is_a_row_not_a_failure(spark, tmp_path):
    (tmp_path / "good.csv").write_text("t,state\n0,ON\n")
    (tmp_path / "wide.csv").write_text("t,state\n" + "x" * 200_000 + ",ON\n")
    got = {r.source.rsplit("/", 1)[-1]: r.error for r in
           documents.read_csv_rows(spark, str(tmp_path)).select("source", "error").distinct().collect()}
    assert got["good.csv"] is None and got["wide.csv"].startswith("not readable as CSV")


def test_chunk_table_keeps_the_old_version_until_the_new_one_is_complete(spark, tmp_path):
    path = str(tmp_path / "chunks")
    table = spark.createDataFrame([("a", "old"), ("b", "old")], "chunk_id string, text string")
    documents.write_chunks(spark, table, path, stored=False)
    broken = table.withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        documents.write_chunks(spark, broken, path, stored=True)
    assert documents.read_chunks(spark, path).count() == 2
    fresh = spark.createDataFrame([("b", "new"), ("c", "new")], "chunk_id string, text string")
    documents.write_chunks(spark, fresh, path, stored=True)
    got = {r.chunk_id: r.text for r in documents.read_chunks(spark, path).collect()}
    assert got == {"a": "old", "b": "new", "c": "new"}


def test_keys_without_alarm_or_rule_keep_a_row(spark):
    frames = golden_frames(spark)
    quiet = frames.withColumns({"device_id": F.lit("quiet"), "alarm_code": F.lit("NONE")})
    rows = {r.device_id: r for r in alarms.alarm_sets(frames.unionByName(quiet), ["device_id"]).collect()}
    assert (rows["quiet"].effective, rows["quiet"].last, rows["quiet"]["all"]) == ([], [], [])
    assert len(rows) == 2
    seg = spark.createDataFrame([("a", 0, ["R1"]), ("b", 0, [])],
                                "device_id string, seg_index int, rule_hits array<string>")
    assert {r.device_id: r.rule_codes for r in rules.window_codes(seg, ["device_id"]).collect()} == {
        "a": ["R1"], "b": []}


def unit(*x):
    n = sum(v * v for v in x) ** 0.5
    return [v / n for v in x]


def test_every_query_is_searched_or_reported(spark):
    chunks = spark.createDataFrame([(i, unit(1.0, i / 10)) for i in range(30)],
                                   "chunk_id long, embedding array<double>")
    details = spark.createDataFrame([(i, f"text {i}", f"/m/{i}.md") for i in range(1, 30)],
                                    "chunk_id long, text string, source string")
    queries = spark.createDataFrame([(1, p, f"q{p % 10}", unit(1.0, p / 10)) for p in range(12)],
                                    "case_id long, query_pos long, query_text string, query_vec array<double>")
    found = search.retrieve(chunks, queries, details=details)
    assert found.queries.count() == 10 and found.dropped.count() == 0
    assert found.recalled.groupBy("query_pos").count().filter("count <> 3").count() == 0
    lost = found.recalled.filter("chunk_id = 0").collect()
    assert lost and all(r.text is None for r in lost)
    few = search.retrieve(chunks, queries, details=details, max_queries=8)
    assert few.queries.count() == 8
    assert sorted(r.query_text for r in few.dropped.collect()) == ["q8", "q9"]
    tiny = R.top_k(chunks, found.queries, 3, block_bytes=20)
    whole = R.top_k(chunks, found.queries, 3)
    key = ["case_id", "query_pos", "chunk_id", "score", "rank"]
    assert sorted(tiny.select(key).collect()) == sorted(whole.select(key).collect())
    for k, recall in ((0, None), (21, None), (5, 4), (5, 51)):
        with pytest.raises(ValueError):
            search.retrieve(chunks, queries, scorer=lambda h: F.col("score"), k=k, recall_k=recall)


def test_hits_without_chunk_id_do_not_collapse(spark):
    hits = spark.createDataFrame(
        [(1, 0, None, "a.md", "x", 0.9, "q"), (1, 1, None, "a.md", "y", 0.8, "r"),
         (1, 2, None, "a.md", "x", 0.7, "s"), (1, 0, 5, "b.md", "z", 0.6, "q"), (1, 1, 5, "b.md", "z", 0.5, "r")],
        "case_id long, query_pos long, chunk_id long, source string, text string, score double, query_text string")
    got = [(r.position, r.chunk_id, r.text, r.hit_by) for r in R.merge_hits(hits, "score").orderBy("position").collect()]
    assert got == [(1, None, "x", "q"), (2, None, "y", "r"), (3, 5, "z", "q")]


def test_gathered_vision_text_has_the_notes(spark):
    frames = standin.load_telemetry(spark, "/root/testdata/sf0.001")
    cases, images = standin.cases(frames), standin.images(frames)
    merged = diagnosis.gather(cases, frames, images).select("trace_id", "vision_summary")
    want = vision.summaries(vision.with_notes(images))
    both = want.join(merged, "trace_id")
    assert both.count() > 0 and both.filter("summary <> vision_summary").count() == 0
    assert both.filter(F.col("summary").contains("未计入 findings")).count() > 0
