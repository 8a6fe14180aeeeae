"""The published bearing case: 361 frames with known segment metrics and rule hits."""

import datetime as dt
import math

import pytest

from rotorsight import limits as L
from rotorsight.operators.rules import judge, window_codes
from rotorsight.operators.runs import Series
from rotorsight.operators.segments import overall_metrics, segment_metrics, telemetry_runs


def golden_rows():
    start = dt.datetime(2026, 11, 17)
    for i in range(361):
        minute = i / 12
        temp = 48 + max(0, minute - 5) * 1.5
        yield (start + dt.timedelta(seconds=5 * i), "PUMP-DEMO-BEARING-01",
               round(100 + math.sin(i / 10) * 0.5, 3), 0.312, 0.02, round(temp, 3), 45.0,
               round(1.5 + max(0, minute - 5) * 0.15, 3), 1.4, 22.5,
               "NORMAL" if minute < 5 else "DEGRADING", "TAHH-101" if temp >= 80 else "")


def golden_frames(spark):
    types = ["timestamp", "string"] + ["double"] * 8 + ["string", "string"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(L.TELEMETRY_COLUMNS, types))
    return spark.createDataFrame(list(golden_rows()), schema)


@pytest.mark.parametrize("slice_seconds,block", [(6 * 3600, 1024), (60, 3), (25, 4), (5, 7)])
def test_segments_match_published_values(spark, slice_seconds, block):
    series = Series(slice_seconds=slice_seconds, block=block)
    runs = telemetry_runs(golden_frames(spark), series)
    segments = judge(segment_metrics(runs, series))
    first, second = segments.orderBy("seg_index").collect()
    expected = [
        (first, dict(state="NORMAL", duration_sec=295, data_points=60, avg_flow=100.0, cv_flow=0.36,
                     cv_press=0.0, slope_temp_de=0.0, slope_vib_de=0.0, max_temp_de=48.0,
                     max_vib_de=1.5, cv_flow_peak=0.31, cv_press_peak=0.0, rule_hits=[],
                     ramp_start_time=None)),
        (second, dict(state="DEGRADING", duration_sec=1500, data_points=301, avg_flow=100.02,
                      cv_flow=0.35, cv_press=0.0, slope_temp_de=1.5, slope_vib_de=0.15,
                      max_temp_de=85.5, max_vib_de=5.25, max_vib_nde=1.4, avg_motor_current=22.5,
                      cv_flow_peak=0.31, avg_press_out=0.312, avg_press_in=0.02,
                      ramp_start_time=dt.datetime(2026, 11, 17, 0, 5, 55),
                      rule_hits=["BEARING_TEMP_DE_TRIP", "BEARING_TEMP_DE_RAMP_SHARP",
                                 "VIB_DE_TRIP", "VIB_DE_DOMINANT"])),
    ]
    for row, values in expected:
        assert {k: row[k] for k in values} == values
    overall = overall_metrics(runs, segments, series).collect()[0]
    assert overall.total_points == 361 and overall.phase_count == 2
    assert overall.avg_flow == pytest.approx(100.01494182825485, abs=1e-9)
    assert (overall.max_temp_de, overall.min_press_in) == (85.5, 0.02)
    codes = window_codes(segments, ["device_id"]).collect()[0].rule_codes
    assert codes == expected[1][1]["rule_hits"]
