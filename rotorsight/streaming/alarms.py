"""Alarm codes and operating states on a telemetry stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import limits as L
from ..functions.scalars import alarm_from_readings
from ..operators.alarms import SPECIAL_STATES


def with_alarms(frames: DataFrame, intent: str = "phase_intent") -> DataFrame:
    """Stateless: the same expression as in batch."""
    return frames.withColumn("alarm", alarm_from_readings(F.col(intent) == L.SHUTDOWN))


def with_states(frames: DataFrame, intent: str = "phase_intent") -> DataFrame:
    """Operating state with hysteresis; three short values of keyed state per device.

    Frames of a device are taken in time order within a micro-batch; frames that arrive in a
    later batch continue from the stored state.
    """
    special, hold = list(SPECIAL_STATES), L.HOLD_TEMP

    def resolve(key, batches, state):
        alarm, planned, marker = state.get if state.exists else ("NONE", "", "")
        rows = pd.concat(list(batches)).sort_values("timestamp")
        states = []
        for now_alarm, now_intent, temp in zip(rows["alarm"], rows["intent"], rows["temp_de"]):
            held = alarm != "NONE" and planned not in special
            if now_intent in special:
                marker = now_intent
            elif now_alarm != "NONE" or held:
                marker = "WARNING"
            elif now_intent == "DEGRADING":
                marker = "DEGRADING"
            elif temp < hold:
                marker = "NORMAL"
            # Otherwise warm without a reason of its own: only DEGRADING is carried on.
            undecided = not (now_intent in special or now_alarm != "NONE" or held
                             or now_intent == "DEGRADING" or temp < hold)
            states.append(("DEGRADING" if marker == "DEGRADING" else "NORMAL") if undecided
                          else marker)
            alarm, planned = now_alarm, now_intent
        state.update((alarm, planned, marker))
        yield rows.assign(state=states)[["device_id", "timestamp", "alarm", "state"]]

    narrow = with_alarms(frames, intent).select(
        "device_id", "timestamp", "alarm", F.col(intent).alias("intent"), "temp_de")
    return narrow.groupBy("device_id").applyInPandasWithState(
        resolve, "device_id string, timestamp timestamp, alarm string, state string",
        "alarm string, intent string, marker string", "append", "NoTimeout")
