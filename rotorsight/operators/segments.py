"""Telemetry segments: statistics, rolling variation, ramps (built on ``runs``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import limits as L
from ..functions.scalars import is_alarm, stable_round
from ..session import materialise
from .runs import Series, number_runs, segment_number, stitch

HALO = L.CV_WINDOW_ROWS - 1
# Means of these are kept relative to the rated figure: less cancellation when runs are merged.
CENTRE = {"flow_rate": L.RATED_FLOW, "press_out": L.RATED_PRESS_OUT, "temp_de": L.RATED_TEMP,
          "vib_rms_de": L.RATED_VIB}
MAXIMA = ["temp_de", "temp_nde", "vib_rms_de", "vib_rms_nde", "motor_current"]


def rolling_stats(rows: DataFrame, part: list[str], ts: str, ramps: bool = True) -> DataFrame:
    """Add ``cv_flow``, ``cv_press`` and (with ``ramps``) ``ramp``: variation, temperature slope.

    Frames stay inside a run. Each window function is computed once as a column of its own;
    readings are never null (see ``sources.telemetry.violations``), so ``rn`` is the frame size.
    """
    in_run = W.partitionBy(*part, "run").orderBy(ts)
    cv_window = in_run.rowsBetween(-(L.CV_WINDOW_ROWS - 1), 0)
    slope_window = in_run.rowsBetween(-(L.SLOPE_WINDOW_ROWS - 1), 0)
    values = {"flow": "flow_rate", "press": "press_out"}
    moments = {f"_{k}_mean": F.avg(v).over(cv_window) for k, v in values.items()}
    moments |= {f"_{k}_sd": F.stddev_samp(v).over(cv_window) for k, v in values.items()}
    if ramps:
        moments["_slope"] = F.regr_slope("temp_de", "x").over(slope_window)
    cv = {f"cv_{k}": F.when((F.col("rn") >= L.CV_MIN_ROWS) & (F.col(f"_{k}_mean") > 1e-6),
                            F.col(f"_{k}_sd") / F.col(f"_{k}_mean") * 100) for k in values}
    if ramps:
        cv["ramp"] = F.when(F.col("rn") >= L.SLOPE_WINDOW_ROWS, F.col("_slope"))
    return rows.withColumns(moments).withColumns(cv).drop(*moments)


def telemetry_runs(frames: DataFrame, series: Series = Series(), alarms: bool = False,
                   ramps: bool = True) -> DataFrame:
    """Reduce frames to runs of one state within a slice. One shuffle; written out once.

    Without ``ramps`` no rolling slope is computed, and ``segment_metrics`` has no
    ``ramp_start_time``; no rule reads it.
    """
    part = [*series.keys, "slice"]
    minutes = (F.unix_micros(series.ts)
               - F.col("slice") * F.lit(series.slice_seconds * 1_000_000)) / 60e6
    rows = number_runs(frames, series).withColumns(
        {"last_run": F.max("run").over(W.partitionBy(*part)), "x": minutes})
    rows = rolling_stats(rows, part, series.ts, ramps)

    n = F.count(F.lit(1))
    edge_row = F.struct(F.col(series.ts).alias("t"), F.col("flow_rate").alias("flow"),
                        F.col("press_out").alias("press"), F.col("temp_de").alias("temp"))
    is_head = (F.col("run") == 1) & (F.col("rn") <= HALO)
    is_tail = (F.col("run") == F.col("last_run")) & (F.col("run_rows") - F.col("rn") < HALO)
    full_frame = F.col("rn") >= L.CV_WINDOW_ROWS
    aggs = [
        F.first(series.state).alias("state"), F.min(series.ts).alias("start"),
        F.max(series.ts).alias("end"), n.alias("n"),
        F.avg("x").alias("x_mean"), (F.var_pop("x") * n).alias("x_m2"),
        *[F.avg(F.col(c) - v).alias(f"{c}_mean") for c, v in CENTRE.items()],
        *[(F.var_pop(c) * n).alias(f"{c}_m2") for c in ("flow_rate", "press_out")],
        *[(F.covar_pop("x", c) * n).alias(f"{c}_xy") for c in ("temp_de", "vib_rms_de")],
        F.sum("press_in").alias("press_in_sum"), F.min("press_in").alias("press_in_min"),
        F.sum("motor_current").alias("motor_current_sum"), F.sum("flow_rate").alias("flow_sum"),
        *[F.max(c).alias(f"{c}_max") for c in MAXIMA],
        *[F.max(F.when(full_frame, F.col(c))).alias(f"{c}_full") for c in ("cv_flow", "cv_press")],
        *[F.max(F.when(~full_frame, F.col(c))).alias(f"{c}_short")
          for c in ("cv_flow", "cv_press")],
        *([F.min(F.when(F.col("ramp") >= L.SLOPE_SHARP, F.col(series.ts))).alias("ramp_time")]
          if ramps else []),
        F.array_sort(F.collect_list(F.when(is_head, edge_row))).alias("head"),
        F.array_sort(F.collect_list(F.when(is_tail, edge_row))).alias("tail"),
    ]
    if alarms:
        valid = is_alarm("alarm_code")
        aggs += [
            F.collect_set(F.when(valid, F.col("alarm_code"))).alias("alarm_set"),
            F.max(F.when(valid, F.struct(F.col(series.ts).alias("t"), "alarm_code")))
             .alias("last_alarm"),
        ]
    return materialise(rows.groupBy(*part, "run").agg(*aggs))


def slice_units(runs: DataFrame, series: Series) -> DataFrame:
    """One row per slice, as ``stitch`` expects it."""
    return runs.groupBy(*series.keys, "slice").agg(
        F.max("run").alias("n_runs"), F.min_by("state", "run").alias("first_state"),
        F.max_by("state", "run").alias("last_state"), F.max("start").alias("last_start"),
        F.max_by("tail", "run").alias("tail"))


# Rolling values over a short array of edge rows (at most 23 + 23 structs t, flow, press, temp):
# the same frames as ``rolling_cv`` and ``rolling_slope``, folded in place instead of shuffled.
_EDGE_CV = """
array_max(transform(sequence(past_rows + 1, size(strip)), i -> aggregate(
    slice(strip, greatest(1, i - {back}), least(i, {back} + 1)),
    named_struct('n', 0D, 'mean', 0D, 'm2', 0D),
    (a, r) -> named_struct('n', a.n + 1,
                           'mean', a.mean + (r.{field} - a.mean) / (a.n + 1),
                           'm2', a.m2 + (r.{field} - a.mean) * (r.{field} - a.mean)
                                        * a.n / (a.n + 1)),
    a -> CASE WHEN a.n >= {least} AND a.mean > 1e-6
              THEN sqrt(a.m2 / (a.n - 1)) / a.mean * 100 END)))
"""
_EDGE_RAMP = """
array_min(transform(filter(sequence(past_rows + 1, size(strip)), i -> i >= {rows}), i -> aggregate(
    slice(strip, i - {rows} + 1, {rows}),
    named_struct('n', 0D, 'x', 0D, 'y', 0D, 'xx', 0D, 'xy', 0D),
    (a, r) -> named_struct(
        'n', a.n + 1,
        'x', a.x + ((unix_micros(r.t) - unix_micros(strip[i - {rows}].t)) / 6e7D - a.x) / (a.n + 1),
        'y', a.y + (r.temp - a.y) / (a.n + 1),
        'xx', a.xx + pow((unix_micros(r.t) - unix_micros(strip[i - {rows}].t)) / 6e7D - a.x, 2)
                     * a.n / (a.n + 1),
        'xy', a.xy + ((unix_micros(r.t) - unix_micros(strip[i - {rows}].t)) / 6e7D - a.x)
                     * (r.temp - a.y) * a.n / (a.n + 1)),
    a -> CASE WHEN a.xx > 0 AND a.xy / a.xx >= {sharp} THEN strip[i - 1].t END)))
"""


def edge_windows(joined: DataFrame) -> DataFrame:
    """Rolling values of the first rows of a continuing run, whose frames reach back a slice."""
    past = F.filter("halo", lambda r: r["t"] >= F.col("carried_start"))
    cv = lambda field: F.expr(_EDGE_CV.format(field=field, back=HALO, least=L.CV_MIN_ROWS))
    ramp = F.expr(_EDGE_RAMP.format(rows=L.SLOPE_WINDOW_ROWS, sharp=L.SLOPE_SHARP))
    edge = lambda value: F.when(F.col("continues"), value)
    return (joined
            .withColumn("past", edge(past))
            .withColumns({"past_rows": F.size("past"),
                          "strip": F.array_sort(F.concat("past", "head"))})
            .withColumns({"cv_flow_edge": edge(cv("flow")), "cv_press_edge": edge(cv("press"))}
                         | ({"ramp_edge": edge(ramp)} if "ramp_time" in joined.columns else {}))
            .drop("past", "past_rows", "strip", "halo", "head"))


def segment_metrics(runs: DataFrame, series: Series = Series()) -> DataFrame:
    """One row per segment with the rounded statistics the rules read."""
    keys = list(series.keys)
    carry = stitch(slice_units(runs, series), series, halo_rows=HALO)
    joined = edge_windows(
        runs.drop("tail").join(carry, [*keys, "slice"])
        .withColumns({"seg_index": segment_number(),
                      "continues": F.col("continues") & (F.col("run") == 1)}))
    opened = F.when(F.col("continues"), F.col("carried_start")).otherwise(F.col("start"))
    x_mean = F.col("x_mean") + (F.col("slice") * F.lit(series.slice_seconds * 1_000_000)
                                - F.unix_micros(opened)) / 60e6
    fresh = ~F.col("continues")
    n = F.col("n")
    parts = joined.withColumn("xm", x_mean)
    weighted = lambda c: F.sum(n * F.col(c))
    total = F.sum("n")

    def m2(value, mean):
        return F.greatest(F.lit(0.0), F.sum(f"{value}_m2") + F.sum(n * F.col(mean) * F.col(mean))
                          - weighted(mean) * weighted(mean) / total)

    def slope(value):
        sxx = F.sum("x_m2") + F.sum(n * F.col("xm") * F.col("xm")) \
            - weighted("xm") * weighted("xm") / total
        sxy = F.sum(f"{value}_xy") + F.sum(n * F.col("xm") * F.col(f"{value}_mean")) \
            - weighted("xm") * weighted(f"{value}_mean") / total
        return F.when((total >= 2) & (sxx > 1e-12), sxy / sxx).otherwise(F.lit(0.0))

    def cv(value):
        mean = weighted(f"{value}_mean") / total + CENTRE[value]
        return F.when((total >= 2) & (mean != 0),
                      F.sqrt(m2(value, f"{value}_mean") / (total - 1)) / mean * 100) \
            .otherwise(F.lit(0.0))

    def peak(value):
        best = F.greatest(F.col(f"{value}_full"), F.when(fresh, F.col(f"{value}_short")),
                          F.col(f"{value}_edge"))
        return F.coalesce(F.max(best), F.lit(0.0))

    r = stable_round
    aggs = [
        F.first("state").alias("state"), F.min("start").alias("start"), F.max("end").alias("end"),
        total.alias("data_points"),
        r(weighted("flow_rate_mean") / total + L.RATED_FLOW, 2).alias("avg_flow"),
        r(weighted("press_out_mean") / total + L.RATED_PRESS_OUT, 3).alias("avg_press_out"),
        r(F.sum("press_in_sum") / total, 3).alias("avg_press_in"),
        r(cv("flow_rate"), 2).alias("cv_flow"), r(cv("press_out"), 2).alias("cv_press"),
        r(slope("temp_de"), 3).alias("slope_temp_de"),
        r(F.max("temp_de_max"), 1).alias("max_temp_de"),
        r(F.max("temp_nde_max"), 1).alias("max_temp_nde"),
        r(slope("vib_rms_de"), 3).alias("slope_vib_de"),
        r(F.max("vib_rms_de_max"), 2).alias("max_vib_de"),
        r(F.max("vib_rms_nde_max"), 2).alias("max_vib_nde"),
        r(F.sum("motor_current_sum") / total, 2).alias("avg_motor_current"),
        r(F.max("motor_current_max"), 2).alias("max_motor_current"),
        r(peak("cv_flow"), 2).alias("cv_flow_peak"),
        r(peak("cv_press"), 2).alias("cv_press_peak"),
    ]
    if "ramp_time" in runs.columns:
        aggs.append(F.min(F.least("ramp_time", "ramp_edge")).alias("ramp_start_time"))
    return (parts.groupBy(*keys, "seg_index").agg(*aggs)
            .withColumn("duration_sec", F.expr("unix_seconds(`end`) - unix_seconds(`start`)")))


def overall_metrics(runs: DataFrame, segments: DataFrame, series: Series = Series()) -> DataFrame:
    """Unrounded figures of the whole window plus its first and last state."""
    keys = list(series.keys)
    values = runs.groupBy(*keys).agg(
        F.sum("n").alias("total_points"), F.min("start").alias("window_start"),
        F.max("end").alias("window_end"), F.max("temp_de_max").alias("max_temp_de"),
        F.max("vib_rms_de_max").alias("max_vib_de"), F.max("temp_nde_max").alias("max_temp_nde"),
        F.max("vib_rms_nde_max").alias("max_vib_nde"),
        (F.sum("flow_sum") / F.sum("n")).alias("avg_flow"),
        F.min("press_in_min").alias("min_press_in"))
    view = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("phase_count"), F.min_by("state", "seg_index").alias("start_state"),
        F.max_by("state", "seg_index").alias("end_state"),
        F.bool_or(F.col("state") == L.SHUTDOWN).alias("has_shutdown"))
    return values.join(view, keys)
