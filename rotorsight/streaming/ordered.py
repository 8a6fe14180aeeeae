"""Operating states on a stream whose frames arrive out of order, late, or twice.

Frames of a device wait in keyed state until the watermark says that nothing earlier is to come;
then they leave in time order with their state. Frames that come too late, or with a time that
has been there, leave at once with a note instead of a state. What is kept of a device is bounded
by the allowed disorder, and goes away when the device has been silent for long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import limits as L
from ..operators.alarms import SPECIAL_STATES
from .alarms import with_alarms

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE, REPEATED = "LATE", "REPEATED"
OUTPUT = "device_id string, timestamp timestamp, alarm string, state string, note string"
WAITING = "at long, alarm string, intent string, temp_de double"
CURRENT = "at long, alarm string, intent string, marker string"


def resolve(rows: pd.DataFrame, before: tuple) -> tuple[np.ndarray, tuple]:
    """States of frames in time order, and what the next frame has to know.

    ``before`` and the second result are (alarm, intent, marker) of the last frame so far.
    """
    special = list(SPECIAL_STATES)
    alarm, intent, temp = (rows[c].to_numpy() for c in ("alarm", "intent", "temp_de"))
    last_alarm = np.concatenate([[before[0]], alarm[:-1]])
    last_intent = np.concatenate([[before[1]], intent[:-1]])
    held = (last_alarm != "NONE") & ~np.isin(last_intent.astype(str), special)
    is_special = np.isin(intent.astype(str), special)
    marker = np.where(is_special, intent, np.where((alarm != "NONE") | held, "WARNING", np.where(
        intent == "DEGRADING", "DEGRADING", np.where(temp < L.HOLD_TEMP, "NORMAL", ""))))
    own = marker != ""
    place = np.maximum.accumulate(np.where(own, np.arange(len(rows)), -1))
    carried = np.where(place >= 0, marker[place], before[2])
    state = np.where(own, marker, np.where(carried == "DEGRADING", "DEGRADING", "NORMAL"))
    return state, (alarm[-1], intent[-1], carried[-1])


class OrderedStates(StatefulProcessor):
    """``keep_ms`` is how much longer than the allowed disorder late frames are still reported."""

    def __init__(self, keep_ms: int, idle_ms: int):
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.current = handle.getValueState("current", CURRENT)

    def close(self) -> None:
        pass

    def _rows(self, key, rows: pd.DataFrame, note: str | None) -> pd.DataFrame:
        return pd.DataFrame({
            "device_id": [key[0]] * len(rows), "timestamp": pd.to_datetime(rows["at"].to_numpy(), unit="us"),
            "alarm": rows["alarm"].to_numpy(), "note": [note] * len(rows),
            "state": rows["state"].to_numpy() if note is None else [None] * len(rows)})[
            ["device_id", "timestamp", "alarm", "state", "note"]]

    def handleInputRows(self, key, rows, timerValues):
        last = self.current.get()[0] if self.current.exists() else None
        for batch in rows:
            batch = batch[["at", "alarm", "intent", "temp_de"]]
            if last is not None and (late := batch["at"] <= last).any():
                note = np.where(batch["at"][late] == last, REPEATED, LATE)
                for kind in (LATE, REPEATED):
                    if (note == kind).any():
                        yield self._rows(key, batch[late][note == kind], kind)
                batch = batch[~late]
            if len(batch):
                self.waiting.appendList([tuple(r) for r in batch.itertuples(index=False)])
                self.handle.registerTimer(int(batch["at"].min()) // 1000 - self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        kept = self.current.get() if self.current.exists() else None
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [],
                            columns=["at", "alarm", "intent", "temp_de"])
        if not len(rows):
            if kept is not None and kept[0] // 1000 + self.idle_ms <= mark:
                self.current.clear()
            return
        ready = rows["at"] // 1000 <= mark + self.keep_ms
        later, rows = rows[~ready], rows[ready].sort_values("at", kind="stable")
        if not len(rows):
            return
        again = rows["at"].duplicated()
        if again.any():
            yield self._rows(key, rows[again], REPEATED)
            rows = rows[~again]
        state, end = resolve(rows, tuple(kept[1:]) if kept is not None else ("NONE", "", ""))
        yield self._rows(key, rows.assign(state=state), None)
        last = int(rows["at"].iloc[-1])
        self.current.update((last, *map(str, end)))
        if len(later):
            self.waiting.put([tuple(r) for r in later.itertuples(index=False)])
            self.handle.registerTimer(int(later["at"].min()) // 1000 - self.keep_ms)
        else:
            self.waiting.clear()
            self.handle.registerTimer(last // 1000 + self.idle_ms)


def ordered_states(frames: DataFrame, disorder_seconds: int = 600, keep_seconds: int = 3600,
                   idle_seconds: int = 7 * 86400, intent: str = "phase_intent") -> DataFrame:
    """Device, time, alarm, state and note of a stream, the states as in batch.

    A frame waits until one that is ``disorder_seconds`` newer has been seen on any device. Frames
    behind one that has left get the note LATE, a second frame of one time REPEATED, and no state;
    those more than ``keep_seconds`` later still are dropped by Spark, which counts them. After
    ``idle_seconds`` without frames the state of a device is forgotten. Frames without a time or
    an intent are not on the stream's clock: check them before.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    narrow = with_alarms(frames, intent).select(
        "device_id", "timestamp", F.unix_micros("timestamp").alias("at"), "alarm",
        F.col(intent).alias("intent"), F.col("temp_de").cast("double").alias("temp_de"))
    marked = narrow.withWatermark("timestamp", f"{disorder_seconds + keep_seconds} seconds")
    return marked.groupBy("device_id").transformWithStateInPandas(
        OrderedStates(keep_seconds * 1000, idle_seconds * 1000), OUTPUT, "Append", "EventTime")
