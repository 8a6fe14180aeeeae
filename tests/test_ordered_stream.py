"""The stream in shuffled order against batch; late, repeated and forgotten frames."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorsight import limits as L
from rotorsight.operators import alarms
from rotorsight.streaming import ordered

START = datetime(2026, 1, 1)


def frames(spark, rows):
    """Rows (device, second, intent, temp_de) with quiet readings otherwise."""
    quiet = {c: 0.0 for c in L.READINGS} | {
        "flow_rate": L.FLOW_WARN_LOW + 1, "motor_current": L.CURRENT_LOW_ALARM + 1,
        "press_in": L.PRESS_IN_WARN + 1}
    data = [(d, START + timedelta(seconds=s), i, *[t if c == "temp_de" else v for c, v in quiet.items()])
            for d, s, i, t in rows]
    return spark.createDataFrame(data, "device_id string, timestamp timestamp, phase_intent string, "
                                 + ", ".join(f"{c} double" for c in L.READINGS))


def stream(spark, folder, parts, **bounds):
    """Feed parts of rows one after the other; a far away device moves the clock on at last."""
    source = str(folder / "in")
    schema = frames(spark, parts[0]).schema
    frames(spark, parts[0]).coalesce(1).write.parquet(source)
    live = ordered.ordered_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                                  .parquet(source), **bounds)
    name = f"t{random.getrandbits(40)}"
    query = live.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(folder / "cp")).start()
    try:
        query.processAllAvailable()
        for part in parts[1:]:
            frames(spark, part).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    return [(r.device_id, int((r.timestamp - START).total_seconds()), r.alarm, r.state, r.note)
            for r in spark.table(name).collect()]


def walk(rng, device, n):
    out, intent, temp = [], "NORMAL", 50.0
    for i in range(n):
        if rng.random() < 0.2:
            intent = rng.choice(["NORMAL", "DEGRADING", L.SHUTDOWN, "NORMAL"])
        temp = rng.choice([50.0, 66.0, 70.0, 80.0, 95.0])
        out.append((device, 5 * i, intent, temp))
    return out


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffled_replay_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = walk(rng, "P1", 60) + walk(rng, "P2", 60)
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 60))       # up to a minute too late
    parts = [mixed[i:i + 40] for i in range(0, len(mixed), 40)] + [[("clock", 10 ** 6, "NORMAL", 1.0)]]
    got = stream(spark, tmp_path, parts, disorder_seconds=120, keep_seconds=60)
    want = {(r.device_id, int((r.timestamp - START).total_seconds())): (r.alarm, r.state)
            for r in alarms.resolve_states(frames(spark, rows)).collect()}
    assert {g[:2]: g[2:4] for g in got if g[0] != "clock"} == want
    assert len(got) == len(want) and all(g[4] is None for g in got)


def test_late_repeated_and_forgotten(spark, tmp_path):
    first = [("P1", 0, "DEGRADING", 66.0), ("P1", 5, "NORMAL", 66.0), ("P1", 5, "NORMAL", 66.0)]
    parts = [first, [("clock", 300, "NORMAL", 1.0)], [("clock", 301, "NORMAL", 1.0)],
             [("P1", 2, "NORMAL", 66.0), ("P1", 5, "NORMAL", 66.0), ("P1", 310, "NORMAL", 66.0)],
             [("clock", 20000, "NORMAL", 1.0)], [("clock", 40000, "NORMAL", 1.0)],
             [("P1", 40000, "NORMAL", 66.0)], [("clock", 60000, "NORMAL", 1.0)]]
    got = stream(spark, tmp_path, parts, disorder_seconds=60, keep_seconds=1000, idle_seconds=5000)
    mine = sorted(((s, state, note) for d, s, _, state, note in got if d == "P1"), key=str)
    assert mine == sorted([
        (0, "DEGRADING", None), (5, "DEGRADING", None), (5, None, "REPEATED"), (2, None, "LATE"),
        (5, None, "REPEATED"), (310, "DEGRADING", None),
        (40000, "NORMAL", None)], key=str)                              # nothing known any more


def test_resolve_in_pieces_equals_whole():
    rng = random.Random(3)
    rows = pd.DataFrame({"alarm": [rng.choice(["NONE", "NONE", "TAH"]) for _ in range(200)],
                         "intent": [rng.choice(["NORMAL", "DEGRADING", L.SHUTDOWN]) for _ in range(200)],
                         "temp_de": [rng.choice([50.0, 70.0, None]) for _ in range(200)]})
    whole, end = ordered.resolve(rows, ("NONE", "", ""))
    for size in (1, 7, 50):
        parts, before = [], ("NONE", "", "")
        for i in range(0, 200, size):
            state, before = ordered.resolve(rows.iloc[i:i + size], before)
            parts += state.tolist()
        assert parts == whole.tolist() and before == end
