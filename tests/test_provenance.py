"""Input digests per case: any change shows, order and slicing do not."""

import pytest
from pyspark.sql import functions as F

from rotorsight.operators import cases as C, provenance as P
from test_golden_case import golden_frames

WINDOW = ("2026-11-17T00:00:00", "2026-11-17T00:30:00")
DEVICE = "PUMP-DEMO-BEARING-01"


def cases(spark, note="hot bearing"):
    rows = [("c1", DEVICE, *WINDOW, note, "TAH-101"), ("c2", DEVICE, WINDOW[0], WINDOW[0], None, None),
            ("c3", "none", *WINDOW, "", "")]
    return C.default_windows(spark.createDataFrame(
        rows, "trace_id string, device_id string, start_time string, end_time string, "
              "user_query string, alarm_code string").withColumn("reported_at", F.lit(None).cast("timestamp")))


def photos(spark, name="p"):
    return spark.createDataFrame([("c1", 0, name), ("c1", 1, None)], "trace_id string, pos int, sha256 string")


def digests(spark, frames=None, **kw):
    frames = golden_frames(spark) if frames is None else frames
    return P.case_digests(cases(spark, **{k: v for k, v in kw.items() if k == "note"}), frames,
                          photos=photos(spark, kw.get("photo", "p")))


def test_order_and_partitions_do_not_matter(spark):
    frames = golden_frames(spark)
    first = sorted(digests(spark, frames).collect())
    assert first == sorted(digests(spark, frames.orderBy(F.desc("temp_de")).repartition(9)).collect())
    by_id = {r.trace_id: r for r in first}
    assert [by_id[c].n_telemetry for c in ("c1", "c2", "c3")] == [361, 1, 0]
    assert by_id["c3"].photos_sha256 == by_id["c2"].photos_sha256 == by_id["c3"].telemetry_sha256
    assert len({r.inputs_sha256 for r in first}) == 3


@pytest.mark.parametrize("column, value", [
    ("temp_de", "temp_de + 1e-9D"), ("temp_de", "null"), ("temp_de", "double('NaN')"),
    ("flow_rate", "1e35D"), ("operating_state", "'x'"), ("alarm_code", "null")])
def test_any_change_of_one_frame_shows(spark, column, value):
    frames = golden_frames(spark)
    last = F.col("timestamp") == frames.agg(F.max("timestamp")).first()[0]
    changed = frames.withColumn(column, F.when(last, F.expr(value)).otherwise(F.col(column)))
    got = P.changed_inputs(digests(spark, frames), digests(spark, changed)).collect()
    assert [tuple(r) for r in got] == [("c1", ["telemetry"])]


def test_repeated_and_missing_frames_notes_photos_and_cases(spark):
    frames = golden_frames(spark)
    base = digests(spark, frames)
    names = lambda other: {r.trace_id: r.changed for r in P.changed_inputs(base, other).collect()}
    assert names(digests(spark, frames)) == {}
    assert names(digests(spark, frames.unionByName(frames.limit(1)))).popitem()[1] == ["telemetry"]
    assert names(digests(spark, frames.limit(0))) == {"c1": ["telemetry"], "c2": ["telemetry"]}
    assert names(digests(spark, frames, note="Hot bearing")) == {"c1": ["notes"]}
    assert names(digests(spark, frames, photo="q")) == {"c1": ["photos"]}
    assert names(base.filter("trace_id <> 'c2'")) == {"c2": ["case"]}


def test_fields_do_not_run_into_each_other(spark):
    rows = [("a", "x", "1:y"), ("b", "x1:", "y"), ("c", None, "-"), ("d", "-", None), ("e", "", None)]
    df = spark.createDataFrame(rows, "k string, p string, q string")
    assert len({r.t_sha256 for r in P.digests(df, "k", ["p", "q"], "t").collect()}) == 5
    assert P.digests(df.limit(0), "k", ["p"], "t").count() == 0
