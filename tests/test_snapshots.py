"""Telemetry snapshots: whole versions, crashes, conflicts, files pruned by case windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rotorsight.operators import cases
from rotorsight.sources import snapshots as S

DAY0 = dt.datetime(2026, 1, 1)


def frames(spark, devices, days=1, value=0.0):
    rows = [(d, DAY0 + dt.timedelta(days=i, hours=h), value + h) for d in devices
            for i in range(days) for h in (0, 6, 12, 18)]
    return spark.createDataFrame(rows, "device_id string, timestamp timestamp, temp_de double")


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_append_replace_and_older_versions(spark, tmp_path):
    root = str(tmp_path / "a table")
    first = frames(spark, ["a", "b", "", None])
    assert S.current(spark, root) == 0
    assert S.append(first, root) == 1
    old = S.read(spark, root)
    assert S.append(frames(spark, ["b"], value=50.0), root) == 2
    assert S.replace_devices(frames(spark, ["", "b"], days=70, value=9.0), root) == 3
    want = frames(spark, ["a", None]).unionByName(frames(spark, ["", "b"], days=70, value=9.0))
    assert content(S.read(spark, root)) == content(want)
    assert content(old) == content(S.read(spark, root, 1)) == content(first)
    assert S.replace_devices(frames(spark, [None], value=3.0), root) == 4
    got = S.read(spark, root).filter("device_id is null")
    assert content(got) == content(frames(spark, [None], value=3.0))
    assert S.read(spark, root).filter("device_id = ''").count() == 280


def test_no_rows_null_times_and_other_columns(spark, tmp_path):
    root = str(tmp_path / "t")
    none = frames(spark, ["a"]).limit(0)
    with pytest.raises(ValueError, match="no version"):
        S.read(spark, root)
    assert S.append(none, root) == 1 and S.read(spark, root).count() == 0
    odd = frames(spark, ["a"]).withColumn("timestamp", F.lit(None).cast("timestamp"))
    S.append(odd, root)
    assert content(S.read(spark, root)) == content(odd)
    S.replace_devices(none, root)
    assert S.read(spark, root).count() == 4
    with pytest.raises(ValueError, match="columns differ"):
        S.append(none.drop("temp_de"), root)


@pytest.mark.parametrize("step", ["_write_data", "_write_manifest", "_commit"])
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_leaves_one_whole_version(spark, tmp_path, monkeypatch, step, after):
    root = str(tmp_path / "t")
    S.append(frames(spark, ["a", "b"]), root)
    before, new = content(S.read(spark, root)), frames(spark, ["a", "b"], value=7.0)
    real = getattr(S, step)

    def crash(*args):
        if after:
            real(*args)
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(S, step, crash)
        with pytest.raises(KeyboardInterrupt):
            S.replace_devices(new, root)
    done = step == "_commit" and after
    assert content(S.read(spark, root)) == (content(new) if done else before)
    S.replace_devices(new, root)
    assert content(S.read(spark, root)) == content(new)


def test_a_draft_of_the_log_is_no_version(spark, tmp_path):
    root = str(tmp_path / "t")
    S.append(frames(spark, ["a"]), root)
    (tmp_path / "t" / "log" / "_draft").write_text('{"manifest": "')
    assert S.current(spark, root) == 1 and S.read(spark, root).count() == 4


def test_writers_from_one_version_conflict(spark, tmp_path):
    root = str(tmp_path / "t")
    base = S.append(frames(spark, ["a", "b"]), root)
    assert S.replace_devices(frames(spark, ["a"], value=1.0), root, base) == 2
    with pytest.raises(S.SnapshotConflict):
        S.replace_devices(frames(spark, ["b"], value=2.0), root, base)
    with pytest.raises(S.SnapshotConflict):
        S.append(frames(spark, ["c"]), root, base)
    want = frames(spark, ["b"]).unionByName(frames(spark, ["a"], value=1.0))
    assert S.current(spark, root) == 2 and content(S.read(spark, root)) == content(want)
    assert not list((tmp_path / "t" / "log").glob("_*"))
    assert S.append(frames(spark, ["c"]), root) == 3


def windows(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, device_id string, start_ts timestamp, "
                                       "end_ts timestamp")


def test_files_read_shrink_with_the_cases(spark, tmp_path):
    root = str(tmp_path / "t")
    data = frames(spark, ["hot", *[f"d{i}" for i in range(5)]], days=360)
    S.append(data, root)
    at = lambda day, hour=0: DAY0 + dt.timedelta(days=day, hours=hour)
    all_files = len(S.read(spark, root).inputFiles())
    assert all_files == S.manifest(spark, root).count() == 6 * 12
    one = windows(spark, [("c1", "hot", at(40), at(41))])
    three = windows(spark, [("c1", "hot", at(40), at(41)), ("c2", "hot", at(58, 20), at(59, 7)),
                            ("c3", "d3", at(200, 6), at(200, 6)), ("c4", "d3", at(9), at(8)),
                            ("c5", None, at(1), at(2)), ("c6", "d1", None, at(2)),
                            ("c7", "none", at(1), at(2)), ("c8", "d2", at(5000), at(5001))])
    assert len(S.read(spark, root, windows=one).inputFiles()) == 1
    pruned = S.read(spark, root, windows=three)
    assert len(pruned.inputFiles()) == 3
    found = content(cases.case_frames(three, pruned).drop("slice"))
    assert found == content(cases.case_frames(three, data).drop("slice")) and len(found) == 5 + 2 + 1
    assert S.read(spark, root, windows=three.filter("trace_id = 'c7'")).count() == 0


def test_many_windows_of_one_device_meet_its_files_once_a_month(spark, tmp_path):
    root = str(tmp_path / "t")
    S.append(frames(spark, ["hot"], days=90), root)
    many = spark.range(3000).select(
        F.col("id").cast("string").alias("trace_id"), F.lit("hot").alias("device_id"),
        (F.lit(DAY0) + F.make_dt_interval(hours=F.col("id") % 700)).alias("start_ts")) \
        .withColumn("end_ts", F.col("start_ts") + F.expr("interval 1 hour"))
    assert S.overlapping(S.manifest(spark, root), many).count() == 1
