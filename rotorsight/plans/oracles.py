"""Plain SQL statements of the registered queries, for an independent engine.

They order whole devices and whole windows where the Spark jobs work in slices, so agreement
checks the stitching as well as the formulas.
"""

from __future__ import annotations

from .. import limits as L


def rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listed(values) -> str:
    return "[" + quoted(values) + "]"


def alarm_case(trip: str) -> str:
    hot, shake = "greatest(temp_de, temp_nde)", "greatest(vib_rms_de, vib_rms_nde)"
    return f"""coalesce(nullif(CASE WHEN {trip} THEN '' ELSE concat_ws(';',
      CASE WHEN flow_rate < 85 THEN 'FAL-104' END,
      CASE WHEN motor_current >= 29 THEN 'IAH-106' END,
      CASE WHEN motor_current < 15 THEN 'IAL-105' END,
      CASE WHEN press_in < -0.04 THEN 'PAL-103' END,
      CASE WHEN {hot} >= 70 AND {hot} < 80 THEN 'TAH-101' END,
      CASE WHEN {hot} >= 80 THEN 'TAHH-101' END,
      CASE WHEN {shake} > 3.5 AND {shake} <= 4.5 THEN 'VAH-102' END,
      CASE WHEN {shake} > 4.5 THEN 'VAHH-102' END) END, ''), 'NONE')"""


T = f"""
t0 AS (
  SELECT event_id, event_type, value, CAST(floor(value) AS BIGINT) % 11 - 5 AS j,
    CASE WHEN event_id % 3 = 0 THEN 0
         ELSE 1 + ((event_id // 3) * 2 + event_id % 3 - 1) // 960 END AS dev,
    CASE WHEN event_id % 3 = 0 THEN event_id // 3
         ELSE ((event_id // 3) * 2 + event_id % 3 - 1) % 960 END AS rn
  FROM events),
t1 AS (SELECT *, rn % 48 AS p, (rn // 48 + dev) % 8 AS ph FROM t0),
t2 AS (
  SELECT 'PUMP-IS100-' || lpad(CAST(dev AS VARCHAR), 5, '0') AS device_id, dev, rn, event_type, value,
    TIMESTAMP '2026-09-13 00:02:05' + to_seconds(rn * 5) AS timestamp,
    CAST(CASE ph WHEN 4 THEN 75 + 3.0*j WHEN 3 THEN 0.05 WHEN 7 THEN 42 + 0.1*j ELSE 100 + 0.2*j END AS DOUBLE) AS flow_rate,
    CAST(CASE ph WHEN 4 THEN 0.25 WHEN 3 THEN 0.001 WHEN 7 THEN 0.131 ELSE 0.312 END AS DOUBLE) AS press_out,
    CAST(CASE ph WHEN 4 THEN -0.045 + 0.003*j WHEN 3 THEN 0.0 ELSE 0.02 END AS DOUBLE) AS press_in,
    CAST(CASE ph WHEN 1 THEN 60 + 0.03*p WHEN 2 THEN 68 + 0.3*p WHEN 3 THEN 60 - 0.3*p WHEN 5 THEN 72 + 0.01*j ELSE 45 + 0.1*j END AS DOUBLE) AS temp_de,
    CAST(CASE ph WHEN 2 THEN 55 WHEN 5 THEN 60 ELSE 43 END AS DOUBLE) AS temp_nde,
    CAST(CASE ph WHEN 1 THEN 2.5 WHEN 2 THEN 3.6 + 0.03*p WHEN 3 THEN 0.1 WHEN 4 THEN 5.4 WHEN 5 THEN 3.8 WHEN 6 THEN 2.5 ELSE 1.45 + 0.01*j END AS DOUBLE) AS vib_rms_de,
    CAST(CASE ph WHEN 2 THEN 2.9 WHEN 3 THEN 0.05 WHEN 4 THEN 5.1 WHEN 5 THEN 3.9 WHEN 6 THEN 5.5 ELSE 1.35 END AS DOUBLE) AS vib_rms_nde,
    CAST(CASE ph WHEN 3 THEN 0.05 WHEN 4 THEN 19 WHEN 5 THEN 30 WHEN 6 THEN 15.5 ELSE 22.5 END AS DOUBLE) AS motor_current,
    CASE ph WHEN 1 THEN 'DEGRADING' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'TRIP_SHUTDOWN' WHEN 4 THEN 'CRITICAL_CAVITATION'
            WHEN 5 THEN 'WARNING' WHEN 6 THEN 'UNBALANCE_MISALIGNMENT' ELSE 'NORMAL' END AS operating_state
  FROM t1),
t AS (SELECT *, {alarm_case("operating_state = 'TRIP_SHUTDOWN'")} AS alarm_code FROM t2)
"""


def segment_ctes(src: str, key: str, pre: str = "") -> str:
    """Segments of ``src`` per ``key``: rounded metrics and rule codes, as ``{pre}seg``."""
    def flag(cond, code):
        return f"CASE WHEN {cond} THEN '{code}' END"
    gate = (f"(max_temp_de >= 80 OR (max_temp_de >= 60 AND duration_sec >= 180 "
            f"AND data_points >= 36))")
    rules = ", ".join([
        "CASE WHEN max_temp_de >= 80 THEN 'BEARING_TEMP_DE_TRIP' WHEN max_temp_de >= 70 THEN 'BEARING_TEMP_DE_WARN' END",
        f"CASE WHEN {gate} AND slope_temp_de >= 0.8 AND max_temp_de >= 70 THEN 'BEARING_TEMP_DE_RAMP_SHARP' "
        f"WHEN {gate} AND slope_temp_de >= 0.2 THEN 'BEARING_TEMP_DE_RAMP_SLOW' END",
        "CASE WHEN max_vib_de > 4.5 THEN 'VIB_DE_TRIP' WHEN max_vib_de > 3.5 THEN 'VIB_DE_WARN' END",
        "CASE WHEN max_vib_nde > 4.5 THEN 'VIB_NDE_TRIP' WHEN max_vib_nde > 3.5 THEN 'VIB_NDE_WARN' END",
        "CASE WHEN max_vib_de > 5 AND max_vib_nde > 5 THEN 'VIB_BOTH_HIGH' "
        "WHEN max_vib_de > 5 AND max_vib_nde < 3 THEN 'VIB_DE_DOMINANT' "
        "WHEN max_vib_nde > 5 AND max_vib_de < 3 THEN 'VIB_NDE_DOMINANT' END",
        flag("avg_flow > 20 AND abs((avg_flow - 100) / 100 * 100) > 15", "FLOW_DEV"),
        flag("avg_flow > 20 AND abs((avg_press_out - 0.312) / 0.312 * 100) > 20", "PRESS_OUT_DEV"),
        flag("data_points >= 12 AND (cv_flow_peak >= 12 OR cv_press_peak >= 12)", "CV_UNSTABLE"),
        flag("avg_press_in < -0.04", "PRESS_IN_LOW"),
        "CASE WHEN max_motor_current >= 29 THEN 'CURRENT_HIGH' WHEN avg_motor_current < 16 THEN 'CURRENT_LOW' END",
    ])
    return f"""
{pre}c AS (SELECT *, CASE WHEN lag(operating_state) OVER w IS NULL OR lag(operating_state) OVER w <> operating_state
                    THEN 1 ELSE 0 END AS chg
      FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY timestamp)),
{pre}n AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY {key} ORDER BY timestamp) - 1 AS BIGINT) AS seg_index FROM {pre}c),
{pre}x AS (SELECT *, epoch(timestamp - min(timestamp) OVER (PARTITION BY {key}, seg_index)) / 60.0 AS x FROM {pre}n),
{pre}r AS (SELECT *,
      CASE WHEN count(*) OVER f >= 12 AND avg(flow_rate) OVER f > 1e-6 THEN stddev_samp(flow_rate) OVER f / avg(flow_rate) OVER f * 100 ELSE 0 END AS rcv_flow,
      CASE WHEN count(*) OVER f >= 12 AND avg(press_out) OVER f > 1e-6 THEN stddev_samp(press_out) OVER f / avg(press_out) OVER f * 100 ELSE 0 END AS rcv_press,
      CASE WHEN count(*) OVER g = 12 THEN regr_slope(temp_de, x) OVER g END AS rslope
    FROM {pre}x WINDOW f AS (PARTITION BY {key}, seg_index ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
                       g AS (PARTITION BY {key}, seg_index ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
{pre}m AS (SELECT {key}, seg_index, any_value(operating_state) AS state, min(timestamp) AS "start", max(timestamp) AS "end",
      CAST(count(*) AS BIGINT) AS data_points, CAST(epoch(max(timestamp) - min(timestamp)) AS BIGINT) AS duration_sec,
      {rnd('avg(flow_rate)', 2)} AS avg_flow, {rnd('avg(press_out)', 3)} AS avg_press_out, {rnd('avg(press_in)', 3)} AS avg_press_in,
      {rnd('coalesce(stddev_samp(flow_rate) / avg(flow_rate) * 100, 0)', 2)} AS cv_flow,
      {rnd('coalesce(stddev_samp(press_out) / avg(press_out) * 100, 0)', 2)} AS cv_press,
      {rnd('CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(temp_de, x) END', 3)} AS slope_temp_de, {rnd('max(temp_de)', 1)} AS max_temp_de, {rnd('max(temp_nde)', 1)} AS max_temp_nde,
      {rnd('CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(vib_rms_de, x) END', 3)} AS slope_vib_de, {rnd('max(vib_rms_de)', 2)} AS max_vib_de, {rnd('max(vib_rms_nde)', 2)} AS max_vib_nde,
      {rnd('avg(motor_current)', 2)} AS avg_motor_current, {rnd('max(motor_current)', 2)} AS max_motor_current,
      {rnd('max(rcv_flow)', 2)} AS cv_flow_peak, {rnd('max(rcv_press)', 2)} AS cv_press_peak,
      min(CASE WHEN rslope >= 0.8 THEN timestamp END) AS ramp_start_time
    FROM {pre}r GROUP BY {key}, seg_index),
{pre}seg AS (SELECT *, CASE WHEN state = 'TRIP_SHUTDOWN' THEN CAST([] AS VARCHAR[])
      ELSE [z FOR z IN [{rules}] IF z IS NOT NULL] END AS rule_hits FROM {pre}m)
"""


CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{lab}', '{src}', {'NULL' if x is None else repr(x)})" for c, lab, src, x in L.RULE_CATALOG
) + ") AS v(code, label, source, extra_field))"

SEG = T + "," + segment_ctes("t", "device_id")
METRICS = list(L.SEGMENT_UNITS)

ORACLES: dict[str, str] = {}


def oracle(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = f"WITH {ctes}\n{body}" if ctes else body


oracle("segment_metrics", SEG, f"""SELECT device_id, seg_index, state, {iso('"start"')} AS start_time,
  {iso('"end"')} AS end_time, duration_sec, data_points, avg_flow, avg_press_out, avg_press_in,
  max_temp_de, max_temp_nde, max_vib_de, max_vib_nde, avg_motor_current, max_motor_current FROM seg""")
oracle("segment_cv_slope", SEG, "SELECT device_id, seg_index, cv_flow, cv_press, slope_temp_de, slope_vib_de FROM seg")
oracle("rolling_cv_peak", SEG, "SELECT device_id, seg_index, cv_flow_peak, cv_press_peak FROM seg")
oracle("ramp_start", SEG, f"SELECT device_id, seg_index, {iso('ramp_start_time')} AS ramp_start_time FROM seg")
oracle("segment_rule_hits", SEG + "," + CATALOG, f"""
SELECT device_id, seg_index, h.code, coalesce(label, h.code) AS label,
  '- [' || state || '段 ' || strftime("start", '%H:%M:%S') || '~' || strftime("end", '%H:%M:%S') || '] '
  || coalesce(label, h.code) || '（' || h.code || '）'
  || CASE WHEN extra_field = 'ramp_start_time' AND ramp_start_time IS NOT NULL
          THEN '，约从 ' || strftime(ramp_start_time, '%H:%M:%S') || ' 开始' ELSE '' END AS sentence
FROM (SELECT *, unnest(rule_hits) AS code FROM seg) h LEFT JOIN catalog USING (code)""")
oracle("window_rule_codes", SEG, f"""
SELECT device_id, coalesce(string_agg(code, ';' ORDER BY seg_index, pos), '') AS rule_codes FROM (SELECT DISTINCT device_id FROM seg) LEFT JOIN (
  SELECT device_id, code, min(seg_index) AS seg_index,
         min(list_position({listed(L.RULE_ORDER)}, code)) AS pos
  FROM (SELECT device_id, seg_index, unnest(rule_hits) AS code FROM seg) GROUP BY 1, 2) USING (device_id) GROUP BY 1""")
OVERALL = """overall AS (
  SELECT o.*, phase_count FROM (
    SELECT device_id, count(*) AS total_points, max(temp_de) AS max_temp_de, max(vib_rms_de) AS max_vib_de,
      max(temp_nde) AS max_temp_nde, max(vib_rms_nde) AS max_vib_nde, avg(flow_rate) AS avg_flow, min(press_in) AS min_press_in,
      arg_min(operating_state, timestamp) AS start_state, arg_max(operating_state, timestamp) AS end_state,
      bool_or(operating_state = 'TRIP_SHUTDOWN') AS has_shutdown
    FROM t GROUP BY 1) o JOIN (SELECT device_id, count(*) AS phase_count FROM seg GROUP BY 1) USING (device_id))"""
oracle("overall_view", SEG + "," + OVERALL, f"""
SELECT device_id, CAST(total_points AS BIGINT) AS total_points, CAST(phase_count AS BIGINT) AS phase_count,
  start_state, end_state, has_shutdown, max_temp_de, max_vib_de, max_temp_nde, max_vib_nde,
  {rnd('avg_flow', 6)} AS avg_flow, min_press_in FROM overall""")
oracle("measurements_long", SEG + "," + OVERALL, " UNION ALL ".join(
    [f"SELECT device_id, '{m}' AS name, CAST({m} AS DOUBLE) AS value, '{u}' AS unit, "
     f"'phase:' || seg_index AS segment, {iso(chr(34) + 'start' + chr(34))} AS start_time FROM seg WHERE {m} IS NOT NULL"
     for m, u in L.SEGMENT_UNITS.items()]
    + [f"SELECT device_id, '{m}', {rnd(m, 6)}, '{u}', 'overall', "
       f"(SELECT {iso('min(timestamp)')} FROM t AS q WHERE q.device_id = overall.device_id) FROM overall"
       for m, u in L.OVERALL_UNITS.items()]))
oracle("overall_measurements", T, f"""SELECT device_id, max(temp_de) AS max_temp_de, max(vib_rms_de) AS max_vib_de,
  max(vib_rms_nde) AS max_vib_nde, {rnd('avg(flow_rate)', 6)} AS avg_flow, min(press_in) AS min_press_in,
  CAST(count(*) AS DOUBLE) AS total_points FROM t GROUP BY 1""")
oracle("alarm_sets", T, """
SELECT *, effective AS "all" FROM (
  SELECT device_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(alarm_code, ';')) FILTER (alarm_code <> 'NONE')))), ';'), '') AS effective,
    coalesce(arg_max(alarm_code, timestamp) FILTER (alarm_code <> 'NONE'), '') AS last FROM t GROUP BY 1)""")
oracle("alarm_from_readings", T, f"SELECT device_id, {iso('timestamp')} AS timestamp, alarm_code FROM t")
oracle("state_distribution", T, f"""SELECT device_id, operating_state, CAST(count(*) AS BIGINT) AS frames,
  {iso('min(timestamp)')} AS first_seen, {iso('max(timestamp)')} AS last_seen FROM t GROUP BY 1, 2""")
oracle("alarm_counts", T, """SELECT device_id, code, CAST(count(*) AS BIGINT) AS frames FROM (
  SELECT device_id, unnest(string_split(alarm_code, ';')) AS code FROM t) WHERE code <> 'NONE' GROUP BY 1, 2""")
oracle("day_labels", T, """SELECT device_id, strftime(timestamp, '%Y-%m-%d') AS day,
  CASE WHEN NOT bool_or(alarm_code <> 'NONE') THEN 'normal'
       WHEN bool_or(alarm_code LIKE '%TAHH-101%') THEN 'seal_leak' WHEN bool_or(alarm_code LIKE '%VAHH-102%') THEN 'fault'
       WHEN bool_or(alarm_code LIKE '%VAH-102%' OR alarm_code LIKE '%TAH-101%') THEN 'warning' ELSE 'abnormal' END AS label,
  CAST(count(*) AS BIGINT) AS frames FROM t GROUP BY 1, 2""")
# The stand-in swaps the state of every frame of phase kind 7 to WARNING-free NORMAL, so the raw
# alarms contradict it there; shutdown frames are given the alarms of their readings.
oracle("state_alarm_conflicts", T, f"""SELECT device_id, operating_state, alarm, CAST(count(*) AS BIGINT) AS frames FROM (
  SELECT device_id, operating_state, {alarm_case('false')} AS alarm FROM t)
  WHERE alarm <> 'NONE' AND operating_state IN ('NORMAL', 'TRIP_SHUTDOWN') GROUP BY 1, 2, 3""")
INTENT = """CASE WHEN operating_state = 'WARNING' AND rn % 5 < 2 THEN 'DEGRADING' WHEN operating_state = 'WARNING' THEN 'NORMAL'
     WHEN operating_state = 'NORMAL' AND dev % 3 = 0 THEN 'NORMAL' ELSE operating_state END"""
oracle("state_hysteresis", T + f""",
i0 AS (SELECT device_id, timestamp, temp_de + CASE WHEN rn % 97 < 40 THEN 21 ELSE 0 END AS temp_de, temp_nde, vib_rms_de, vib_rms_nde,
         flow_rate, press_in, motor_current, {INTENT} AS intent FROM t),
i1 AS (SELECT *, {alarm_case("intent = 'TRIP_SHUTDOWN'")} AS alarm FROM i0),
i2 AS (SELECT *, lag(alarm) OVER w AS pa, lag(intent) OVER w AS pi FROM i1 WINDOW w AS (PARTITION BY device_id ORDER BY timestamp)),
i3 AS (SELECT *, CASE WHEN intent IN ('TRIP_SHUTDOWN', 'CRITICAL_CAVITATION', 'UNBALANCE_MISALIGNMENT') THEN intent
     WHEN alarm <> 'NONE' THEN 'WARNING'
     WHEN pa <> 'NONE' AND pi NOT IN ('TRIP_SHUTDOWN', 'CRITICAL_CAVITATION', 'UNBALANCE_MISALIGNMENT') THEN 'WARNING'
     WHEN intent = 'DEGRADING' THEN 'DEGRADING' WHEN temp_de < 65 THEN 'NORMAL' END AS m FROM i2)""",
       f"""SELECT device_id, {iso('timestamp')} AS timestamp, alarm, coalesce(m, CASE WHEN last_value(m IGNORE NULLS) OVER (
         PARTITION BY device_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) = 'DEGRADING' THEN 'DEGRADING' ELSE 'NORMAL' END) AS state FROM i3""")
oracle("event_segments", """
e0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e1 AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS chg
       FROM e0 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e2 AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts) - 1 AS seg FROM e1)""",
       """SELECT user_id, CAST(seg AS BIGINT) AS seg_index, any_value(event_type) AS state, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS start_time,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS end_time, CAST(count(*) AS BIGINT) AS data_points FROM e2 GROUP BY 1, 2""")


# ---- cases -----------------------------------------------------------------------------------------

def sealed(parts, name, rows):
    """Digest per case of the rows: fields as length and text, sums of four parts of SHA-256."""
    text = " || ".join(f"coalesce(length({p}) || ':' || {p}, '-')" for p in parts)
    sums = ", ':', ".join(f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT)) AS VARCHAR)"
                          for at in (1, 16, 31, 46))
    return f"""{name}d AS (SELECT trace_id, count(*) AS n_{name}, sha256(concat(CAST(count(*) AS VARCHAR), ':', {sums})) AS {name}_sha256
  FROM (SELECT trace_id, sha256({text}) AS h FROM {rows}) GROUP BY 1)"""


CASES = T + f""",
cb AS (SELECT device_id AS dev_id, dev, CAST(floor(epoch(timestamp) / 240) AS BIGINT) AS b FROM t GROUP BY 1, 2, 3),
cs AS (SELECT *, b + dev AS k, dev_id || '-' || b AS trace_id,
    CASE WHEN (b + dev) % 11 = 5 THEN '' ELSE dev_id END AS device_id,
    to_timestamp(CASE WHEN (b + dev) % 7 = 3 THEN (b + 1) * 240 - 1200 ELSE b * 240 END)::TIMESTAMP AS start_ts,
    to_timestamp((b + 1) * 240 + CASE WHEN (b + dev) % 7 = 3 THEN 600 ELSE 0 END)::TIMESTAMP AS end_ts,
    {listed(["", "驱动端轴承温度偏高", "机封处有漏液", "入口压力低，疑似气蚀", "   ", "routine check"])}[(b + dev) % 6 + 1] AS user_query,
    CASE (b + dev) % 4 WHEN 1 THEN 'bearing high' WHEN 2 THEN 'TAH-101' WHEN 3 THEN '' END AS alarm_code,
    (b + dev) % 5 = 2 AS degraded FROM cb),
cf AS (SELECT cs.trace_id, t.* FROM cs JOIN t ON t.device_id = cs.device_id AND t.timestamp BETWEEN start_ts AND end_ts),
cq AS (SELECT cs.*, coalesce(n, 0) AS total_points, CAST(floor(epoch(end_ts - start_ts) / 5) AS BIGINT) + 1 AS expected_points
    FROM cs LEFT JOIN (SELECT trace_id, CAST(count(*) AS BIGINT) AS n FROM cf GROUP BY 1) USING (trace_id)),
cd AS (SELECT *, total_points / expected_points * 100 AS coverage_pct,
    CASE WHEN device_id = '' OR total_points = 0 THEN 'EMPTY' WHEN total_points / expected_points * 100 < 90 THEN 'PARTIAL' ELSE 'OK' END AS data_status,
    CASE WHEN trim(user_query) = '' THEN 'EMPTY' ELSE 'RECORDED' END AS text_status, trim(user_query) AS text FROM cq)"""

oracle("case_windows", CASES, f"""SELECT trace_id, device_id, {iso('start_ts')} AS start_time, {iso('end_ts')} AS end_time, total_points AS frames,
  first_frame, last_frame FROM cd LEFT JOIN (SELECT trace_id, {iso('min(timestamp)')} AS first_frame, {iso('max(timestamp)')} AS last_frame
  FROM cf GROUP BY 1) USING (trace_id)""")
oracle("coverage_quality", CASES, f"""SELECT trace_id, total_points, expected_points, {rnd('coverage_pct', 6)} AS coverage_pct, data_status,
  CASE WHEN device_id = '' THEN '无设备码：未提供设备编号，跳过时序数据分析' WHEN total_points = 0 THEN '指定时间窗口内无 SCADA 记录'
       WHEN data_status = 'PARTIAL' THEN printf('窗口内缺失约 %.0f%% 的数据（理论 %d 点，实际 %d 点）', 100 - coverage_pct, expected_points, total_points)
       ELSE '' END AS data_reason FROM cd""")

PHOTOS = """
ph0 AS (SELECT device_id AS dev_id, CAST(floor(epoch(timestamp) / 240) AS BIGINT) + dev AS k,
    device_id || '-' || CAST(floor(epoch(timestamp) / 240) AS BIGINT) AS trace_id, event_type AS kind, count(*) AS n, max(value) AS mv
    FROM t GROUP BY 1, 2, 3, 4),
ph AS (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], kind) - 1 AS pos,
    CASE WHEN kind = 'signup' THEN '' ELSE trace_id || '/' || kind END AS image_id, k % 13 = 4 AS failed,
    CASE WHEN mv > 160 THEN 'SEVERE' WHEN mv > 130 THEN 'MODERATE' WHEN mv > 105 THEN 'MINOR' END AS severity,
    CASE WHEN n % 5 = 0 THEN '' ELSE kind || ' x' || n END AS evidence,
    CASE WHEN kind = 'purchase' THEN '' ELSE 'part-' || kind END AS location,
    CASE kind WHEN 'click' THEN 'LEAK' WHEN 'error' THEN 'CRACK' WHEN 'purchase' THEN 'SCALE' WHEN 'signup' THEN 'WEAR' ELSE 'leak' END AS defect_type,
    CASE WHEN mv / 200 >= 0.8 THEN 'HIGH' WHEN mv / 200 >= 0.5 THEN 'MEDIUM' WHEN mv > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS confidence
    FROM ph0 WHERE k % 3 <> 1),
ab AS (SELECT *, severity IS NOT NULL AND evidence <> '' AS complete FROM ph WHERE mv > 100 AND NOT failed),
fnd AS (SELECT * FROM ab WHERE complete),
vs AS (SELECT trace_id, count(*) AS images, bool_and(failed) AS all_failed FROM ph GROUP BY 1),
vf AS (SELECT trace_id, count(*) AS n_findings, bool_or(upper(defect_type) = 'LEAK') AS leak,
    bool_or(upper(defect_type) = 'LEAK' AND severity IN ('MODERATE', 'SEVERE')) AS leak_ms,
    bool_or(upper(defect_type) = 'LEAK' AND severity = 'SEVERE') AS leak_severe,
    arg_min(location, pos) FILTER (upper(defect_type) = 'LEAK' AND severity = 'SEVERE') AS leak_place,
    bool_or(severity IN ('MODERATE', 'SEVERE')) AS serious, bool_or(severity = 'MINOR') AS minor FROM fnd GROUP BY 1),
vv AS (SELECT cs.trace_id, coalesce(images, 0) AS images, coalesce(n_findings, 0) AS n_findings, coalesce(leak, false) AS leak,
    coalesce(leak_ms, false) AS leak_ms, coalesce(leak_severe, false) AS leak_severe, leak_place, coalesce(serious, false) AS serious,
    coalesce(minor, false) AS minor,
    CASE WHEN images IS NULL THEN 'NO_IMAGE' WHEN all_failed THEN 'FAILED' WHEN n_findings > 0 THEN 'DEFECT_FOUND' ELSE 'NO_DEFECT' END AS vision_status
    FROM cs LEFT JOIN vs USING (trace_id) LEFT JOIN vf USING (trace_id))"""
_text = lambda c: f"CAST({c} AS VARCHAR)"
_frame = [_text("epoch_us(timestamp)"), "device_id", *[_text(f"CAST(CAST({c} AS DECIMAL(28, 9)) * CAST(1000000000 AS DECIMAL(10, 0)) AS DECIMAL(38, 0))")
          for c in L.READINGS], "operating_state", "alarm_code"]
_none = "sha256('0:0:0:0:0')"
oracle("case_input_digests", CASES + "," + PHOTOS.split("ab AS")[0].rstrip().rstrip(",") + ", " + ", ".join([
    sealed(_frame, "telemetry", "cf"), sealed(["user_query", "alarm_code"], "notes", "cs"),
    sealed(["image_id", _text("pos")], "photos", "ph")]) + f""",
dg AS (SELECT trace_id, coalesce(n_telemetry, 0) AS n_telemetry, coalesce(telemetry_sha256, {_none}) AS telemetry_sha256, n_notes, notes_sha256,
  coalesce(n_photos, 0) AS n_photos, coalesce(photos_sha256, {_none}) AS photos_sha256
  FROM cs LEFT JOIN telemetryd USING (trace_id) LEFT JOIN notesd USING (trace_id) LEFT JOIN photosd USING (trace_id))""",
       """SELECT *, sha256('notes:' || notes_sha256 || chr(10) || 'photos:' || photos_sha256 || chr(10) || 'telemetry:' || telemetry_sha256)
  AS inputs_sha256 FROM dg""")
oracle("findings", T + "," + PHOTOS.split("vs AS")[0].rstrip().rstrip(","),
       "SELECT trace_id, pos, CAST(0 AS BIGINT) AS obs_pos, image_id, defect_type, severity, location, confidence, evidence FROM fnd")
oracle("rejected_observations", T + "," + PHOTOS.split("fnd AS")[0].rstrip().rstrip(","),
       "SELECT trace_id, pos, CAST(0 AS BIGINT) AS obs_pos, image_id, '「' || location || '」的异常缺少完整的缺陷要素（defect_type/severity/evidence），未计入 findings' AS note FROM ab WHERE NOT complete")
oracle("vision_status", CASES + "," + PHOTOS, "SELECT trace_id, images, vision_status, n_findings FROM vv")
oracle("vision_summary", T + "," + PHOTOS.split("vs AS")[0].rstrip().rstrip(",") + """,
vl AS (SELECT *, '[图' || (pos + 1) || '] ' || kind || '.png' AS named,
    CASE WHEN failed THEN '（本图识别失败，未产生视觉结论：timeout）' WHEN n % 6 = 0 THEN '' ELSE '照片 ' || kind END AS body,
    concat_ws('；', CASE WHEN n % 4 = 0 THEN '反光' END,
      CASE WHEN mv > 100 AND NOT failed AND (severity IS NULL OR evidence = '')
           THEN '「' || location || '」的异常缺少完整的缺陷要素（defect_type/severity/evidence），未计入 findings' END) AS limits FROM ph),
vt AS (SELECT trace_id,
    string_agg(CASE WHEN body <> '' THEN named || chr(10) || body || CASE WHEN limits <> '' THEN chr(10) || '本图未核验：' || limits ELSE '' END END, chr(10) || chr(10) ORDER BY pos) AS a,
    '未核验汇总：' || chr(10) || string_agg(CASE WHEN limits <> '' THEN '- ' || named || '：' || limits END, chr(10) ORDER BY pos) AS z FROM vl GROUP BY 1)""",
       "SELECT trace_id, concat_ws(chr(10) || chr(10), a, z) AS summary FROM vt")

EVIDENCE = CASES + "," + PHOTOS + "," + segment_ctes("cf", "trace_id", "k_") + f""",
ko AS (SELECT trace_id, max(temp_de) AS max_temp_de, max(vib_rms_de) AS max_vib_de, max(vib_rms_nde) AS max_vib_nde, avg(flow_rate) AS avg_flow,
    min(press_in) AS min_press_in, arg_min(operating_state, timestamp) AS start_state, arg_max(operating_state, timestamp) AS end_state,
    bool_or(operating_state = 'TRIP_SHUTDOWN') AS has_shutdown,
    array_to_string(list_sort(list_distinct(flatten(list(string_split(alarm_code, ';')) FILTER (alarm_code <> 'NONE')))), ';') AS effective,
    arg_max(alarm_code, timestamp) FILTER (alarm_code <> 'NONE') AS last FROM cf GROUP BY 1),
kc AS (SELECT trace_id, count(*) AS phase_count FROM k_seg GROUP BY 1),
kf AS (SELECT trace_id, list(code ORDER BY seg_index, pos) AS flags FROM (
    SELECT trace_id, code, min(seg_index) AS seg_index, min(list_position({listed(L.RULE_ORDER)}, code)) AS pos
    FROM (SELECT trace_id, seg_index, unnest(rule_hits) AS code FROM k_seg) GROUP BY 1, 2) GROUP BY 1),
ev AS (SELECT cd.*, phase_count, coalesce(flags, CAST([] AS VARCHAR[])) AS flags, coalesce(effective, '') AS effective, coalesce(last, '') AS last,
    start_state, end_state, has_shutdown, max_temp_de, max_vib_de, max_vib_nde, avg_flow, min_press_in, vv.* EXCLUDE (trace_id)
    FROM cd JOIN vv USING (trace_id) LEFT JOIN ko USING (trace_id) LEFT JOIN kc USING (trace_id) LEFT JOIN kf USING (trace_id))"""
oracle("case_evidence", EVIDENCE, f"""SELECT trace_id, data_status, text_status, vision_status, total_points, CAST(phase_count AS BIGINT) AS phase_count,
  array_to_string(flags, ';') AS flags, effective, last, start_state, end_state, has_shutdown, max_temp_de, max_vib_de, max_vib_nde, min_press_in,
  {rnd('avg_flow', 6)} AS avg_flow FROM ev""")
DESCRIBED = EVIDENCE + """,
od AS (SELECT trace_id, CAST(pos - 1 AS BIGINT) AS pos, 'THRESHOLD' AS kind, '离线规则计算命中 ' || flags[pos] || '；未调用语言模型。' AS description, flags[pos] AS evidence
    FROM (SELECT trace_id, flags, unnest(range(1, len(flags) + 1)) AS pos FROM ev WHERE data_status <> 'EMPTY')
    UNION ALL SELECT trace_id, 0, 'OTHER', '离线规则计算未命中阈值；未调用语言模型。', '' FROM ev WHERE data_status <> 'EMPTY' AND len(flags) = 0)"""
oracle("offline_descriptions", DESCRIBED, "SELECT * FROM od")
oracle("description_warnings", DESCRIBED, """SELECT trace_id, chars, char_limit, chars > char_limit AS too_long FROM (
  SELECT trace_id, CAST(sum(length(description)) AS BIGINT) AS chars,
    CAST(least(1000, 500 + 40 * greatest(0, any_value(phase_count) - 1)
      + 20 * CASE WHEN any_value(effective) = '' THEN 0 ELSE len(string_split(any_value(effective), ';')) END) AS BIGINT) AS char_limit
  FROM od JOIN ev USING (trace_id) GROUP BY 1)""")
oracle("evidence_whitelist", EVIDENCE, """SELECT trace_id, array_to_string([q FOR q IN ['max_temp_de', 'invented_metric', 'VIB_DE_TRIP', 'FLOW_DEV', 'cv_flow']
  IF (total_points > 0 AND q IN ('max_temp_de', 'cv_flow')) OR list_contains(flags, q)], ';') AS evidence FROM ev""")

TOPIC_ROWS = "topics AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, " + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
                          for v in (t[0], t[1], t[2], t[3], t[7], t[8], t[9], t[10])) + ")"
    for i, t in enumerate(L.MANUAL_TOPICS)) + ") AS v(ord, topic, chunk, section, page, requirement, action, priority, mechanism))"
MANUAL = EVIDENCE + f""",
tp AS (SELECT *, list_has_any(flags, {listed(L.BEARING_CODES)}) OR coalesce(upper(alarm_code), '') LIKE '%BEARING%'
      OR user_query LIKE '%轴承%' OR user_query LIKE '%振动%' OR user_query LIKE '%温度%' AS t_bearing,
    list_has_any(flags, ['PRESS_IN_TRIP', 'PRESS_IN_LOW', 'CV_UNSTABLE', 'FLOW_DEV']) OR coalesce(upper(alarm_code), '') LIKE '%CAVITATION%'
      OR user_query LIKE '%气蚀%' OR user_query LIKE '%压力%' AS t_cavitation,
    leak OR user_query LIKE '%漏%' AS t_seal, list_has_any(flags, ['CURRENT_HIGH', 'CURRENT_LOW']) AS t_motor FROM ev),
{TOPIC_ROWS},
mt AS (SELECT trace_id, topics.* FROM tp JOIN topics ON (topic = 'bearing' AND t_bearing) OR (topic = 'cavitation' AND t_cavitation)
    OR (topic = 'seal' AND t_seal) OR (topic = 'motor' AND t_motor)
    OR (topic = 'general' AND NOT (t_bearing OR t_cavitation OR t_seal OR t_motor)))"""
oracle("builtin_manual", MANUAL, """SELECT trace_id, string_agg(chunk, ';' ORDER BY ord) AS chunks, coalesce(string_agg(requirement, ';' ORDER BY ord), '') AS requirements,
  string_agg(action, ';' ORDER BY ord) AS actions, string_agg(mechanism, '；' ORDER BY ord) AS mechanism FROM mt GROUP BY 1""")


def clause_values() -> str:
    from .standin import CLAUSES
    rows = []
    for doc, chunk, _, _, _, codes, words, _, action, mechanism in CLAUSES:
        cell = lambda v: "NULL" if v is None else f"'{v}'"
        rows.append(f"('{doc}', '{chunk}', {listed(codes + words)}, {cell(action)}, {cell(mechanism)})")
    return "clauses AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(doc_id, chunk_id, terms, action, mechanism))"


MATCHED = EVIDENCE + "," + clause_values() + """,
cm AS (SELECT trace_id, doc_id, chunk_id, action, mechanism, CAST(len(terms) AS BIGINT) AS n_terms,
    CAST(len([z FOR z IN terms IF list_contains(flags, z) OR contains(text || ' ' || coalesce(alarm_code, ''), z)]) AS BIGINT) AS hits FROM ev CROSS JOIN clauses),
cr AS (SELECT *, hits / n_terms AS score, row_number() OVER (PARTITION BY trace_id ORDER BY hits / n_terms DESC, chunk_id) AS rank FROM cm WHERE hits > 0)"""
oracle("clause_match", MATCHED, f"SELECT trace_id, rank, doc_id, chunk_id, hits, n_terms, {rnd('score', 6)} AS score FROM cr WHERE rank <= 5")
oracle("clause_evidence", MATCHED, """SELECT trace_id, CASE WHEN count(chunk_id) > 0 THEN 'HIT' ELSE 'NO_HIT' END AS manual_status,
  coalesce(string_agg(chunk_id, ';' ORDER BY rank), '') AS chunks, coalesce(string_agg(action, ';' ORDER BY rank), '') AS actions,
  coalesce(string_agg(mechanism, '；' ORDER BY rank), '') AS mechanism FROM cs LEFT JOIN cr USING (trace_id) GROUP BY 1""")

ATTRIBUTED = MANUAL + f""",
a0 AS (SELECT *, [z FOR z IN [CASE WHEN data_status IN ('OK', 'PARTIAL') THEN 'DATA' END,
      CASE WHEN vision_status IN ('DEFECT_FOUND', 'NO_DEFECT') AND n_findings > 0 THEN 'VISION' END, 'MANUAL',
      CASE WHEN text_status = 'RECORDED' THEN 'ENGINEER_TEXT' END] IF z IS NOT NULL] AS sources FROM ev),
a1 AS (SELECT *, list_has_any(flags, {listed(L.BEARING_CODES_ATTRIBUTION)}) AS is_b, list_has_any(flags, {listed(L.CAVITATION_CODES)}) AS is_c FROM a0),
a2 AS (SELECT *, CASE WHEN is_b THEN 'BEARING_DEGRADATION' WHEN is_c THEN 'CAVITATION' WHEN leak THEN 'SEAL_LEAK' ELSE 'NORMAL' END AS proposal_mode,
    CASE WHEN is_b OR is_c THEN CASE WHEN len(sources) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END WHEN leak THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
    data_status = 'EMPTY' AS insufficient,
    CASE WHEN list_has_any(flags, ['BEARING_TEMP_DE_TRIP', 'VIB_DE_TRIP']) AND vision_status = 'NO_DEFECT' THEN '{L.CONFLICT_TEXT}' ELSE '' END AS conflicts FROM a1)"""
oracle("attribution", ATTRIBUTED, f"""SELECT trace_id, proposal_mode, confidence, array_to_string(sources, ';') AS sources, insufficient, conflicts,
  CASE WHEN is_b THEN array_to_string(list_sort(list_intersect(flags, {listed(L.BEARING_CODES_ATTRIBUTION)})), ';')
       WHEN is_c THEN array_to_string(list_sort(list_intersect(flags, {listed(L.CAVITATION_CODES)})), ';')
       WHEN leak THEN (SELECT string_agg(CASE WHEN image_id <> '' THEN image_id ELSE 'vision_finding_' || r END, ';' ORDER BY r) FROM (
            SELECT trace_id, image_id, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS r FROM fnd WHERE upper(defect_type) = 'LEAK') q WHERE q.trace_id = a2.trace_id)
       ELSE '' END AS support,
  CASE WHEN proposal_mode = 'NORMAL' THEN '综合【' || array_to_string(sources, ', ') || '】，未见明显恶化异常，各项参数在允许波动范围内。'
       ELSE '综合【' || array_to_string(sources, ', ') || '】得出初步判断：' || CASE proposal_mode
         WHEN 'BEARING_DEGRADATION' THEN '{L.FAILURE_MODE_LABELS["BEARING_DEGRADATION"]}' WHEN 'CAVITATION' THEN '{L.FAILURE_MODE_LABELS["CAVITATION"]}'
         ELSE '{L.FAILURE_MODE_LABELS["SEAL_LEAK"]}' END || '。' END AS summary FROM a2""")

RANK = "CASE {0} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
MODE_RANK = "CASE failure_mode " + " ".join(
    f"WHEN '{m}' THEN {L.RISK_LEVELS.index(r)}" for m, r in L.FAILURE_MODE_RISK.items()) + " ELSE 1 END"


def verdict_ctes(source: str, high_risk: str = "false") -> str:
    """Verdict of the attributed cases in ``source`` as w4; ``high_risk`` is a condition on a case."""
    return f"""
w0 AS (SELECT *, list_sort(list_intersect(flags, {listed(L.TRIP_RULES)})) AS trips, {high_risk} AS high_risk FROM {source}),
w1 AS (SELECT *,
    coalesce(max_temp_de >= 80, false) AND NOT list_contains(trips, 'BEARING_TEMP_DE_TRIP') AS x_temp, coalesce(max_vib_de >= 4.5, false) AND NOT list_contains(trips, 'VIB_DE_TRIP') AS x_de,
    coalesce(max_vib_nde >= 4.5, false) AND NOT list_contains(trips, 'VIB_NDE_TRIP') AS x_nde, coalesce(min_press_in <= -0.055, false) AND NOT list_contains(trips, 'PRESS_IN_TRIP') AS x_press,
    vision_status = 'FAILED' OR data_status = 'FAILED' AS failed, vision_status = 'NO_IMAGE' AND data_status = 'EMPTY' AND text_status = 'EMPTY' AS vacuum,
    list_has_any(flags, {listed(L.RED_LINE_CODES)}) AND vision_status = 'NO_DEFECT' AS unseen,
    list_contains(flags, 'CURRENT_HIGH') AND (coalesce(avg_flow < 85, false) OR list_contains(flags, 'PRESS_IN_LOW')) AS starved FROM w0),
w2 AS (SELECT *, len(trips) > 0 OR x_temp OR x_de OR x_nde OR x_press OR leak_severe AS trip, failed OR vacuum AS stop, conflicts <> '' OR unseen OR starved AS conflict,
    NOT (failed OR vacuum) AND list_contains(sources, 'DATA') AND data_status = 'EMPTY' AS false_data, NOT (failed OR vacuum) AND list_contains(sources, 'VISION') AND vision_status = 'NO_IMAGE' AS false_image,
    data_status = 'PARTIAL' AND NOT (failed OR vacuum) AS partial,
    CASE WHEN list_has_any(flags, {listed(L.BEARING_CODES)}) THEN 'BEARING_DEGRADATION' WHEN is_c THEN 'CAVITATION' WHEN leak_ms THEN 'SEAL_LEAK'
         WHEN list_contains(flags, 'CURRENT_HIGH') THEN 'MOTOR_OVERLOAD' WHEN proposal_mode IS NOT NULL AND NOT insufficient THEN proposal_mode
         WHEN len(sources) = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NORMAL' END AS failure_mode FROM w1),
w3 AS (SELECT *, CASE WHEN trip THEN 4 ELSE greatest({MODE_RANK}, CASE WHEN list_has_any(flags, {listed(L.WARN_RULES)}) OR serious OR conflict THEN 3
      WHEN minor OR list_has_any(flags, ['FLOW_DEV', 'PRESS_OUT_DEV']) OR data_status = 'PARTIAL' THEN 2 ELSE 1 END) END AS lv FROM w2),
w4 AS (SELECT *, {listed(L.RISK_LEVELS)}[lv + 1] AS risk_level,
    CASE WHEN lv = 4 THEN 'BLOCK' WHEN stop THEN 'INSUFFICIENT_DATA'
         WHEN high_risk OR conflict OR false_data OR false_image OR (data_status = 'PARTIAL' AND confidence IN ('LOW', 'UNKNOWN')) OR lv = 3 THEN 'MANUAL_REVIEW'
         WHEN lv = 2 THEN CASE WHEN confidence = 'HIGH' AND NOT degraded THEN 'PASS' ELSE 'MANUAL_REVIEW' END ELSE 'PASS' END AS decision,
    list_sort(list_distinct(list_concat(trips, [z FOR z IN [CASE WHEN x_temp THEN 'BEARING_TEMP_DE_TRIP' END, CASE WHEN x_de THEN 'VIB_DE_TRIP' END,
      CASE WHEN x_nde THEN 'VIB_NDE_TRIP' END, CASE WHEN x_press THEN 'PRESS_IN_TRIP' END, CASE WHEN leak_severe THEN 'RULE_SEVERE_LEAK_TRIP' END,
      CASE WHEN failed THEN 'RULE_EVIDENCE_FAILURE_GUARD' WHEN vacuum THEN 'RULE_EMPTY_INPUT_GUARD' END, CASE WHEN partial THEN 'RULE_DATA_PARTIAL_GUARD' END,
      CASE WHEN false_data OR false_image THEN 'RULE_INPUT_HALLUCINATION_GUARD' END, CASE WHEN high_risk THEN 'RULE_HIGH_RISK_DEVICE_GUARD' END,
      CASE WHEN conflict THEN 'RULE_EVIDENCE_CONFLICT' END] IF z IS NOT NULL]))) AS rule_hits FROM w3)"""


VERDICT = ATTRIBUTED + "," + CATALOG + "," + verdict_ctes("a2")
VERDICT_ROWS = f"""SELECT w4.trace_id, decision, risk_level, failure_mode, array_to_string(rule_hits, ';') AS rule_hits, '1.0.0' AS rule_version,
  coalesce(nullif(concat_ws('|',
    (SELECT string_agg('触发紧急停机线/急剧恶化判据【' || code || '】: ' || label || ' (依据: ' || source || ')。', '|' ORDER BY code)
       FROM (SELECT trace_id, unnest(trips) AS code FROM w4) q JOIN catalog USING (code) WHERE q.trace_id = w4.trace_id),
    CASE WHEN x_temp THEN printf('实测驱动端最高温度 %.1f℃ 越过停机线 (80.0℃)，强制停机拦截。', max_temp_de) END,
    CASE WHEN x_de THEN printf('实测驱动端最高振动 %.2fmm/s 越过停机线 (4.5mm/s)，强制停机拦截。', max_vib_de) END,
    CASE WHEN x_nde THEN printf('实测非驱动端最高振动 %.2fmm/s 越过停机线 (4.5mm/s)，强制停机拦截。', max_vib_nde) END,
    CASE WHEN x_press THEN printf('实测入口吸上压力 %.3fMPa 低于脱流停机线 (-0.055MPa)，气蚀毁泵先兆。', min_press_in) END,
    CASE WHEN leak_severe THEN '视觉检出严重介质喷淋泄漏 (' || leak_place || ')，触发一级安全阻断。' END,
    CASE WHEN failed THEN '{L.REASON_FAILED}' WHEN vacuum THEN '{L.REASON_EMPTY}' END,
    CASE WHEN false_data THEN '{L.REASON_NO_DATA}' END, CASE WHEN false_image THEN '{L.REASON_NO_IMAGE}' END,
    CASE WHEN partial AND confidence IN ('LOW', 'UNKNOWN') THEN '{L.REASON_PARTIAL}' END,
    CASE WHEN high_risk THEN '设备【' || device_id || '】属于高危/核心主干管网保护名单，系统剥夺自动放行权限，锁定为人工复核签审。' END,
    CASE WHEN conflicts <> '' THEN '归因引擎检出跨模态冲突: ' || conflicts
         WHEN unseen THEN '物理证据严重矛盾: 时序触发红线告警 [' || array_to_string([chr(39) || z || chr(39) FOR z IN list_sort(list_intersect(flags, {listed(L.RED_LINE_CODES)}))], ', ')
           || ']，但现场图片判定为无缺陷完好，需人工排查传感器真伪。'
         WHEN starved THEN '{L.REASON_HYDRAULIC}' END), ''), '{L.REASON_GREEN}') AS reasons FROM w4"""
oracle("verdict", VERDICT, VERDICT_ROWS)
# Stored proposals, failed data and protected devices reach the other branches of the verdict.
GUARDED = ATTRIBUTED.replace(
    "\na0 AS (", "\nevg AS (SELECT * REPLACE (CASE WHEN b % 9 = 1 THEN 'FAILED' ELSE data_status END AS data_status) FROM ev),\na0 AS (").replace(
    "IF z IS NOT NULL] AS sources FROM ev)", "IF z IS NOT NULL] AS sources FROM evg)") + """,
a3 AS (SELECT * REPLACE (CASE WHEN b % 4 = 0 THEN 'SEAL_LEAK' ELSE proposal_mode END AS proposal_mode, CASE WHEN b % 4 = 0 THEN 'LOW' ELSE confidence END AS confidence,
    CASE WHEN b % 4 = 0 THEN ['DATA', 'VISION'] ELSE sources END AS sources, CASE WHEN b % 8 = 0 THEN 'given' WHEN b % 4 = 0 THEN '' ELSE conflicts END AS conflicts,
    CASE WHEN b % 4 = 0 THEN b % 3 = 0 ELSE insufficient END AS insufficient) FROM a2)"""
oracle("guarded_verdict", GUARDED + "," + CATALOG + "," + verdict_ctes(
    "a3", "device_id <> '' AND (contains(upper(device_id), 'IS100-00001') OR contains(upper(device_id), '00000'))"), VERDICT_ROWS)
oracle("service_levels", VERDICT + ", matrix AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}', CAST({d} AS DOUBLE))" for a, b, c, d in L.RISK_MATRIX) + ") AS v(risk_level, name, default_decision, sla_hours))",
       "SELECT risk_level, name, default_decision, sla_hours, decision, CAST(count(*) AS BIGINT) AS cases FROM w4 JOIN matrix USING (risk_level) GROUP BY 1, 2, 3, 4, 5")
GUARDS = "guards AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', {b}, '{c}', '{d}', '{e}')" for a, b, c, d, e in L.GUARD_ACTIONS) + ") AS v(decision, ord, action, priority, source_id))"
oracle("protected_actions", VERDICT + "," + GUARDS, f"""SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY grp, ord) - 1 AS BIGINT) AS pos, action, priority, source_id FROM (
  SELECT trace_id, 0 AS grp, ord, action, priority, source_id FROM w4 JOIN guards USING (decision)
  UNION ALL SELECT trace_id, 1, mt.ord, action, priority, '{L.MANUAL_DOC}#' || chunk FROM mt JOIN w4 USING (trace_id) WHERE decision IN ('MANUAL_REVIEW', 'PASS'))""")
CHAIN = VERDICT + f""",
ch AS (SELECT trace_id, 0 AS grp, i AS ord, 'THRESHOLD' AS kind, flags[i] AS id, 'data.threshold_flags @ ' || {iso('start_ts')} || '~' || {iso('end_ts')} AS locator
      FROM (SELECT *, unnest(range(1, len(flags) + 1)) AS i FROM w4)
    UNION ALL SELECT trace_id, 1, r, 'VISION', CASE WHEN image_id <> '' THEN image_id ELSE 'img_' || r END, CASE WHEN location <> '' THEN location ELSE 'pump_body' END
      FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS r FROM fnd) JOIN w4 USING (trace_id)
    UNION ALL SELECT trace_id, 2, ord, 'MANUAL', '{L.MANUAL_DOC}#' || chunk, 'page ' || page || ' · ' || section FROM mt
    UNION ALL SELECT trace_id, 3, i, 'RULE', rule_hits[i], 'verdict rules' FROM (SELECT *, unnest(range(1, len(rule_hits) + 1)) AS i FROM w4))"""
oracle("evidence_chain", CHAIN, "SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY grp, ord) - 1 AS BIGINT) AS pos, kind, id, locator FROM ch")
oracle("dispatch", CHAIN, """SELECT trace_id, 'dispatch://' || CASE decision WHEN 'BLOCK' THEN 'emergency_shutdown' WHEN 'INSUFFICIENT_DATA' THEN 'resurvey_checklist'
    WHEN 'MANUAL_REVIEW' THEN 'manual_review_draft' ELSE 'closed_loop_order' END || '/' || device_id || '/' || trace_id AS address, true AS hashed,
  (SELECT CAST(count(*) AS BIGINT) FROM ch WHERE ch.trace_id = w4.trace_id) AS chain_length FROM w4""")
oracle("latest_reviews", "", """SELECT o_custkey AS trace_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'REWORK' ELSE 'REJECTED' END, key) AS decision,
  arg_max(reviewer, key) AS reviewer, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS reviewed_at, CAST(count(*) AS BIGINT) AS reviews FROM (
    SELECT *, o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS reviewer,
      strftime(o_orderdate, '%Y%m%d') || o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key FROM orders) GROUP BY 1""")
oracle("telemetry_violations", T + f""",
z AS (SELECT *, CASE WHEN rn % 113 = 5 THEN timestamp - INTERVAL 5 SECOND ELSE timestamp END AS ts2 FROM t)""", f"""
SELECT 'not_numeric' AS "check", device_id, {iso('ts2')} AS timestamp, 'temp_de' AS detail FROM z WHERE rn % 101 = 7
UNION ALL SELECT 'not_finite', device_id, {iso('ts2')}, 'temp_de' FROM z WHERE rn % 103 = 9 AND rn % 101 <> 7
UNION ALL SELECT 'not_finite', device_id, {iso('ts2')}, 'press_in' FROM z WHERE rn % 107 = 3
UNION ALL SELECT 'unknown_state', device_id, {iso('ts2')}, 'OFFLINE' FROM z WHERE rn % 109 = 4
UNION ALL SELECT 'duplicate_time', device_id, {iso('ts2')}, CAST(count(*) AS VARCHAR) FROM z GROUP BY device_id, ts2 HAVING count(*) > 1""")


# ---- retrieval -------------------------------------------------------------------------------------

def search_ctes(parts: int, pre: str = "") -> str:
    return f"""
{pre}m0 AS (SELECT CAST(label AS BIGINT) AS case_id, vec_id % {parts} AS query_pos, i, avg(x) AS x
    FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2, 3),
{pre}q0 AS (SELECT case_id, query_pos, list(x ORDER BY i) AS v FROM {pre}m0 GROUP BY 1, 2),
{pre}q AS (SELECT case_id, query_pos, 'label ' || case_id || ' part ' || query_pos AS query_text,
    [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS qv FROM {pre}q0),
{pre}sc AS (SELECT case_id, query_pos, query_text, vec_id AS chunk_id, round(greatest(-1, least(1, list_dot_product(qv, CAST(embedding AS DOUBLE[])))), 9) AS score,
    round(1 - list_sum([abs(z[1] - z[2]) FOR z IN list_zip(qv, CAST(embedding AS DOUBLE[]))]) / len(qv), 9) AS rerank, label FROM {pre}q CROSS JOIN embeddings),
{pre}rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, query_pos ORDER BY score DESC, chunk_id) - 1 AS rank FROM {pre}sc),
{pre}rc AS (SELECT rk.*, text, '/manuals/' || source || '.md' AS source FROM {pre}rk AS rk JOIN documents ON chunk_id = doc_id WHERE rank < 15),
{pre}rp AS (SELECT case_id, query_pos, any_value(query_text) AS query_text, count(*) AS returned, max(score) AS top1, avg(score) AS mean, min(score) AS lowest,
    coalesce(max(score) - max(score) FILTER (rank = 1), 0) AS head_gap, count(DISTINCT source) AS distinct_sources, max(score) < 0.5 AS low_confidence FROM {pre}rc GROUP BY 1, 2),
{pre}rr AS (SELECT * FROM (SELECT rc.*, row_number() OVER (PARTITION BY case_id, query_pos ORDER BY rerank DESC, rank) - 1 AS rerank_rank
    FROM {pre}rc AS rc SEMI JOIN (SELECT * FROM {pre}rp WHERE NOT low_confidence) p USING (case_id, query_pos)) WHERE rerank_rank < 3),
{pre}mg AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rerank DESC, chunk_id) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY rerank DESC, query_pos) AS pick FROM {pre}rr) WHERE pick = 1)"""


SEARCH = search_ctes(4)
oracle("topk_cosine", SEARCH, f"SELECT case_id, query_pos, chunk_id, rank, {rnd('score', 6)} AS score FROM rk WHERE rank < 5")
oracle("indexed_exhaustive", "", f"""SELECT case_id, query_pos, chunk_id, rank, {rnd('score', 6)} AS score FROM (
  SELECT CAST(q.label AS BIGINT) AS case_id, q.vec_id AS query_pos, c.vec_id AS chunk_id, s AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, c.vec_id) - 1 AS rank
  FROM embeddings q, embeddings c, LATERAL (SELECT greatest(-1.0, least(1.0, list_dot_product(
    CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS s) WHERE q.vec_id % 100 = 0) WHERE rank < 15""")
oracle("term_documents", "", """SELECT term, count(*) AS n_docs FROM (
  SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark) WHERE length(term) >= 6)
  JOIN documents ON contains(text, term) GROUP BY term""")
oracle("min_score_hits", SEARCH, "SELECT case_id, query_pos, chunk_id, rank FROM rk WHERE rank < 15 AND score >= 0.45")
oracle("retrieval_report", SEARCH, f"""SELECT case_id, query_pos, returned, {rnd('top1', 6)} AS top1, {rnd('mean', 6)} AS mean, {rnd('lowest', 6)} AS lowest,
  {rnd('head_gap', 6)} AS head_gap, distinct_sources, low_confidence FROM rp""")
oracle("gated_retrieval", SEARCH, f"SELECT case_id, query_pos, chunk_id, rank, rerank_rank, {rnd('score', 6)} AS score, {rnd('rerank', 6)} AS rerank FROM rr")
oracle("merged_retrieval", SEARCH, f"SELECT case_id, chunk_id, position, query_text AS hit_by, {rnd('rerank', 6)} AS rerank FROM mg")
oracle("two_round_retrieval", SEARCH + "," + search_ctes(3, "z"), f"""SELECT case_id, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY r DESC, chunk_id) AS position, hit_by, round, {rnd('r', 6)} AS rerank FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY r DESC, round, query_pos) AS pick FROM (
    SELECT case_id, chunk_id, query_pos, query_text AS hit_by, rerank AS r, CAST(1 AS BIGINT) AS round FROM rr
    UNION ALL SELECT case_id, chunk_id, query_pos, query_text, rerank, 2 FROM zrr)) WHERE pick = 1""")
oracle("retrieval_rules", SEARCH, """SELECT case_id, docs, total, refused, concat_ws(';', CASE WHEN docs = 0 THEN 'empty' END,
    CASE WHEN refused >= total THEN 'all_refused' WHEN total >= 2 AND refused / total >= 0.5 THEN 'majority_refused' END,
    CASE WHEN docs > 0 AND top1 >= 0.5 AND top1 < 0.6 THEN 'grey_zone' END) AS rules FROM (
  SELECT case_id, total, refused, coalesce(docs, 0) AS docs, top1 FROM (SELECT case_id, count(*) AS total, CAST(sum(CAST(low_confidence AS INT)) AS BIGINT) AS refused FROM rp GROUP BY 1)
  LEFT JOIN (SELECT case_id, count(*) AS docs, max(score) AS top1 FROM mg GROUP BY 1) USING (case_id))""")
oracle("retrieval_summary", SEARCH, f"""SELECT case_id, docs, sources, {rnd('gap_before', 6)} AS gap_before, {rnd('gap_after', 6)} AS gap_after FROM
  (SELECT case_id, count(chunk_id) AS docs, count(DISTINCT source) AS sources FROM (SELECT DISTINCT case_id FROM q) LEFT JOIN mg USING (case_id) GROUP BY 1) LEFT JOIN
  (SELECT case_id, avg(rp.head_gap) AS gap_before, avg(g.gap) AS gap_after FROM rp JOIN (
     SELECT case_id, query_pos, coalesce(max(rerank) - max(rerank) FILTER (rerank_rank = 1), 0) AS gap FROM rr GROUP BY 1, 2) g USING (case_id, query_pos) GROUP BY 1) USING (case_id)""")
BLOCKS = SEARCH + f""",
bl AS (SELECT *, chr(10) || printf('[%d] 重排分 %.3f｜', position, rerank) || string_split(source, '/')[-1] || ' | chapter ' || label || chr(10) || '    命中查询：' || query_text || chr(10)
    || CASE WHEN length(text) > 1200 THEN substring(text, 1, 1200) || '{L.TRUNCATED_MARK}' ELSE text END AS block FROM mg),
bs AS (SELECT *, sum(length(block)) OVER (PARTITION BY case_id ORDER BY position) <= 4000 AS shown FROM bl)"""
oracle("context_budget", BLOCKS, "SELECT case_id, position, chunk_id, length(block) AS block_chars, shown FROM bs")
oracle("context_text", BLOCKS, """SELECT case_id, count(chunk_id) AS hits, count(*) FILTER (NOT shown) AS left_out, md5(concat_ws(chr(10), coalesce(string_agg(block, chr(10) ORDER BY position) FILTER (shown), ''),
  CASE WHEN count(*) FILTER (NOT shown) > 0 THEN chr(10) || printf('（其余 %d 条超出上下文预算，未展示）', count(*) FILTER (NOT shown)) END)) AS context_md5 FROM (SELECT DISTINCT case_id FROM q) LEFT JOIN bs USING (case_id) GROUP BY 1""")
oracle("retrieval_text", BLOCKS + """,
ql AS (SELECT case_id, count(*) AS queries, count(*) FILTER (low_confidence) AS refused, string_agg('  ' || CASE WHEN low_confidence THEN '✗ 低置信拒答' ELSE '✓' END || ' ' || returned
    || printf(' 条 | retrieval_score top1=%.3f 均值=%.3f 最低=%.3f 头距=%.3f | 来源 ', top1, mean, lowest, head_gap) || distinct_sources || ' 个' || CASE WHEN low_confidence THEN '  ⚠️ 低置信' ELSE '' END
    || '｜' || query_text, chr(10) ORDER BY query_pos) AS lines FROM rp GROUP BY 1),
gp AS (SELECT case_id, avg(rp.head_gap) AS gb, avg(g.gap) AS ga FROM rp JOIN (
     SELECT case_id, query_pos, coalesce(max(rerank) - max(rerank) FILTER (rerank_rank = 1), 0) AS gap FROM rr GROUP BY 1, 2) g USING (case_id, query_pos) GROUP BY 1),
tx AS (SELECT case_id, string_agg(block, chr(10) ORDER BY position) FILTER (shown) AS blocks, count(*) AS docs, count(DISTINCT source) AS sources, count(*) FILTER (NOT shown) AS hidden FROM bs GROUP BY 1),
al AS (SELECT ql.*, gb, ga, blocks, hidden, coalesce(docs, 0) AS docs, coalesce(sources, 0) AS sources FROM ql LEFT JOIN gp USING (case_id) LEFT JOIN tx USING (case_id)),
ft AS (SELECT case_id, concat_ws(chr(10), '知识库检索结果｜共 ' || queries || ' 条查询｜' || queries || ' 条 query -> 去重后 ' || docs || ' 条片段 | 来源 ' || sources || ' 个 | 低置信 ' || refused || ' 条 | 重排'
      || CASE WHEN gb IS NOT NULL THEN printf(' | head_gap %.3f→%.3f', gb, ga) ELSE '' END, lines,
    CASE WHEN refused > 0 THEN '（上述 ' || refused || ' 条查询知识库中无相关内容，按约定未返回其片段）' END,
    CASE WHEN gb IS NOT NULL THEN printf('  （重排收敛：head_gap 均值 %.3f → %.3f）', gb, ga) ELSE '  （已启用重排：片段按重排分排序，下方分数为**重排分**，与相似度不可比）' END,
    CASE WHEN docs = 0 THEN chr(10) || '请如实告知用户知识库中没有相关资料，并可以建议用户换个说法或补充背景信息；不要凭已有知识作答。'
      ELSE concat_ws(chr(10), coalesce(blocks, ''), CASE WHEN hidden > 0 THEN chr(10) || printf('（其余 %d 条超出上下文预算，未展示）', hidden) END) END) AS t FROM al)""",
       "SELECT case_id, length(t) AS chars, md5(t) AS text_md5 FROM ft")
oracle("refusals", SEARCH, """SELECT case_id, query_pos, '知识库中没有找到与问题相关的内容。' || chr(10) || '查询：' || query_text || chr(10) || printf('检索到的最高相似度 %.3f，低于置信度阈值 ', top1)
  || '0.5——按约定此时不提供片段，以免基于不相关内容编造答案。' || chr(10) || '请如实告知用户知识库中没有相关资料，并可以建议用户换个说法或补充背景信息；不要凭已有知识作答。' AS message FROM rp WHERE low_confidence""")
oracle("query_cleanup", r"""
u AS (SELECT conv_id AS case_id, turn, trim(text) AS text, regexp_replace(regexp_replace(text, '[\s\p{Z}]+', '', 'g'), '[？?。.！!；;，,]+$', '') AS key FROM conversations WHERE role = 'user'),
o AS (SELECT case_id, arg_min(text, turn) AS text, arg_min(key, turn) AS key FROM u GROUP BY 1),
d AS (SELECT case_id, key, min(turn) AS turn, arg_min(text, turn) AS text FROM u WHERE text <> '' GROUP BY 1, 2),
n AS (SELECT d.*, row_number() OVER (PARTITION BY d.case_id ORDER BY d.turn) AS n FROM d ANTI JOIN o ON d.case_id = o.case_id AND d.key = o.key)""",
       """SELECT o.case_id, coalesce(n.n, 1) AS n, md5(coalesce(n.text, o.text)) AS query_md5, n.text IS NULL AS degraded
  FROM o LEFT JOIN (SELECT * FROM n WHERE n <= 4) n ON o.case_id = n.case_id""")


# ---- documents ---------------------------------------------------------------------------------

WS = r"chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288) || chr(8232) || chr(8233) || chr(133)"


def folded(x: str) -> str:
    """White space folding of a text, as SQL."""
    x = f"regexp_replace({x}, '\\\\([_*#\\[\\]()~`])', '\\1', 'g')"
    x = f"regexp_replace({x}, '(?m)[ \\t]+$', '', 'g')"
    x = f"regexp_replace({x}, '[\\t\\f\\r\\x0b  　 ]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({x}, {WS})"


oracle("text_normalise", "", f"""SELECT doc_id, length(z) AS chars, md5(z) AS text_md5 FROM (SELECT doc_id,
  {folded("replace(text, ', ', ' ' || chr(92) || '_ ' || chr(9) || ' ') || ' ' || repeat(chr(10), 4) || ' x '")} AS z FROM documents)""")
oracle("repeated_lines", f"""
p AS (SELECT doc_id, [trim(l, {WS}) FOR l IN string_split({folded('text')}, chr(10))] AS ls FROM documents),
c AS (SELECT unnest(list_distinct(list_concat(ls[1:3], ls[greatest(1, len(ls) - 2):len(ls)]))) AS line FROM p)""",
       """SELECT md5(line) AS line_md5, count(*) AS pages, (SELECT count(*) FROM p) AS n_pages,
  count(*) >= 0.6 * (SELECT count(*) FROM p) AND length(line) <= 60 AS is_header FROM c WHERE line <> '' GROUP BY line""")
oracle("text_quality", "", f"""SELECT *, chars >= 24 AND digits >= 4 AND (units <> '' OR tags <> '' OR keys <> '') AS credible FROM (
  SELECT doc_id, length(regexp_replace(text, '[\\s 　]+', '', 'g')) AS chars, length(regexp_replace(text, '\\D', '', 'g')) AS digits,
    array_to_string(list_sort(list_distinct([lower(z) FOR z IN regexp_extract_all(text, '{L.QUALITY_UNIT_PATTERN}', 1)])), ';') AS units,
    array_to_string(list_sort(list_distinct([upper(z) FOR z IN regexp_extract_all(text, '{L.QUALITY_TAG_PATTERN}', 1)])), ';') AS tags,
    array_to_string(list_sort(list_distinct([upper(z) FOR z IN regexp_extract_all(text, '{L.QUALITY_KEY_PATTERN}', 1)])), ';') AS keys FROM documents)""")

PAGES = f"""
d0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
d1 AS (SELECT *, (doc_id * 7 + i * 13) % 17 AS h, regexp_replace(substring(line, 1, 12), '[^A-Za-z ]', '', 'g') AS w, doc_id % 3 <> 0 AS md FROM d0),
pg AS (SELECT doc_id, source, string_agg(CASE h
    WHEN 0 THEN CASE WHEN md THEN '# ' || substring(line, 1, 20) ELSE '1 x' || w END || chr(10) || line
    WHEN 1 THEN CASE WHEN md THEN '## ' || substring(line, 1, 20) ELSE '2 x' || w END || chr(10) || line
    WHEN 2 THEN CASE WHEN md THEN '### ' || substring(line, 1, 20) ELSE '3 x' || w END || chr(10) || line
    WHEN 3 THEN (i % 5) || '.2 x' || w || chr(10) || line WHEN 4 THEN '- ' || line WHEN 5 THEN '| ' || line || ' |' WHEN 6 THEN '|---|---|' || chr(10) || line
    WHEN 7 THEN chr(10) || line WHEN 8 THEN '附录A 标题' || chr(10) || line ELSE line END, chr(10) ORDER BY i) AS text FROM d1 GROUP BY doc_id, source)"""
# Normalised pages without the lines that most PDF pages have near an edge.
CLEAN = PAGES + f""",
pf AS (SELECT doc_id, source, doc_id % 2 = 0 AS pdf, {folded('text')} AS text FROM pg),
ps AS (SELECT *, string_split(text, chr(10)) AS ls FROM pf),
hc AS (SELECT unnest(list_distinct([trim(l, {WS}) FOR l IN list_concat(ls[1:3], ls[greatest(1, len(ls) - 2):len(ls)]) IF trim(l, {WS}) <> ''])) AS line FROM ps WHERE pdf),
hl AS (SELECT coalesce(list(line), []) AS lines FROM (SELECT line FROM hc GROUP BY line
    HAVING (SELECT count(*) FROM ps WHERE pdf) >= {L.MIN_PAGES_FOR_HEADER} AND count(*) >= {L.HEADER_MIN_RATIO} * (SELECT count(*) FROM ps WHERE pdf) AND length(line) <= {L.HEADER_MAX_LEN})),
pc AS (SELECT doc_id, source, CASE WHEN list_has_any([trim(l, {WS}) FOR l IN ls], hl.lines)
    THEN trim(array_to_string([l FOR l IN ls IF NOT list_contains(hl.lines, trim(l, {WS}))], chr(10)), {WS}) ELSE text END AS text FROM ps, hl)"""


def line_ctes(pages: str) -> str:
    """Classified lines of the pages in a CTE with doc_id, source and text."""
    return f"""
d2 AS (SELECT doc_id, source, i, trim(line, {WS}) AS line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {pages})),
l0 AS (SELECT *, regexp_matches(line, '{L.MD_HEADING_PATTERN}') AS is_md, regexp_matches(line, '^\\|') AS is_pipe, regexp_matches(line, '{L.TABLE_SEPARATOR_PATTERN}') AS is_sep,
    regexp_matches(line, '{L.LIST_ITEM_PATTERN}') AS is_item, regexp_extract(line, '{L.NUMBER_HEADING_PATTERN}', 1) AS num, regexp_extract(line, '{L.NUMBER_HEADING_PATTERN}', 2) AS rest
    FROM d2 WHERE line <> ''),
l1 AS (SELECT *, CASE WHEN is_md THEN length(regexp_extract(line, '{L.MD_HEADING_PATTERN}', 1)) WHEN length(line) > 30 THEN NULL
    WHEN num <> '' THEN CASE WHEN NOT (regexp_matches(rest, '\\d') OR regexp_matches(rest, '{L.UNIT_PATTERN}') OR contains(rest, '□') OR regexp_matches(rest, '{L.SENTENCE_END_PATTERN}')
        OR (NOT contains(num, '.') AND length(line) > 20)) THEN len(string_split(num, '.')) END
    WHEN (regexp_matches(line, '{L.APPENDIX_HEADING_PATTERN}') OR regexp_matches(line, '{L.CHINESE_HEADING_PATTERN}')) AND NOT regexp_matches(line, '{L.SENTENCE_END_PATTERN}') THEN 1 END AS lvl FROM l0),
l2 AS (SELECT *, sum(CASE WHEN lvl = lag(lvl) OVER w THEN 0 ELSE 1 END) OVER w AS toc, sum(CASE WHEN is_pipe AND lag(is_pipe) OVER w AND lag(i) OVER w = i - 1 THEN 0 ELSE 1 END) OVER w AS pr,
    bool_or(is_md) OVER (PARTITION BY doc_id) AS page_md FROM (SELECT * FROM l1) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l3 AS (SELECT *, lvl IS NOT NULL AND (page_md OR count(*) OVER (PARTITION BY doc_id, toc) < 3) AS heading, bool_or(is_sep) OVER (PARTITION BY doc_id, pr) AS has_sep FROM l2),
l4 AS (SELECT *, CASE WHEN heading THEN 'text' WHEN is_pipe AND has_sep THEN 'table' WHEN is_item THEN 'list' ELSE 'text' END AS type FROM l3),
l5 AS (SELECT *, sum(CASE WHEN heading OR type IS DISTINCT FROM pt THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block,
    sum(CAST(heading AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS heading_no FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY i) AS pt FROM l4))""".replace(
    "sum(CASE WHEN lvl = lag(lvl) OVER w THEN 0 ELSE 1 END) OVER w AS toc, sum(CASE WHEN is_pipe AND lag(is_pipe) OVER w AND lag(i) OVER w = i - 1 THEN 0 ELSE 1 END) OVER w AS pr",
    "sum(CASE WHEN lvl = pl THEN 0 ELSE 1 END) OVER w AS toc, sum(CASE WHEN is_pipe AND pp AND pi = i - 1 THEN 0 ELSE 1 END) OVER w AS pr").replace(
    "FROM (SELECT * FROM l1)", "FROM (SELECT *, lag(lvl) OVER (PARTITION BY doc_id ORDER BY i) AS pl, lag(is_pipe) OVER (PARTITION BY doc_id ORDER BY i) AS pp, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS pi FROM l1)")


LINES = PAGES + "," + line_ctes("pg")
HEADINGS = f""",
hd AS (SELECT source, doc_id, i, heading_no, lvl, trim(regexp_replace(trim(regexp_replace(line, '{L.MD_HEADING_PATTERN}', '\\2'), {WS}), '^[*_`]+|[*_`]+$', '', 'g'), {WS}) AS title,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS j FROM l5 WHERE heading),
st(source, j, stack) AS (SELECT DISTINCT source, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM documents
    UNION ALL SELECT hd.source, hd.j, list_append(stack[1:least(len(stack), lvl - 1)], title) FROM st JOIN hd ON hd.source = st.source AND hd.j = st.j + 1)"""
PATHS = LINES + HEADINGS
ORACLES["table_runs"] = f"""WITH {LINES} SELECT source, doc_id AS part, type, count(*) AS lines, count(DISTINCT block) AS blocks, CAST(sum(CAST(heading AS INT)) AS BIGINT) AS headings
  FROM l5 GROUP BY 1, 2, 3"""
ORACLES["heading_paths"] = f"""WITH RECURSIVE {PATHS} SELECT hd.source, doc_id AS part, CAST(heading_no AS BIGINT) AS heading_no, CAST(lvl AS BIGINT) AS level, title,
  CAST(len(stack) AS BIGINT) AS depth, array_to_string(stack, ' > ') AS path FROM hd JOIN st ON hd.source = st.source AND hd.j = st.j"""
BLOCK_CTES = """,
b0 AS (SELECT source, doc_id, block, any_value(type) AS content_type, min(i) AS i0, string_agg(line, chr(10) ORDER BY i) AS raw_text FROM l5 GROUP BY 1, 2, 3),
b1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, block) AS ordinal FROM b0),
b2 AS (SELECT b1.*, coalesce((SELECT max(j) FROM hd WHERE hd.source = b1.source AND (hd.doc_id < b1.doc_id OR (hd.doc_id = b1.doc_id AND hd.i <= b1.i0))), 0) AS j FROM b1),
b3 AS (SELECT b2.*, stack, md5(b2.source || chr(31) || '{"page": ' || doc_id || '}' || chr(31) || ordinal) AS rec_id FROM b2 JOIN st ON st.source = b2.source AND st.j = b2.j WHERE length(raw_text) >= 8),
rec AS (SELECT * FROM b3 WHERE len(stack) > 0 OR source NOT IN (SELECT source FROM b3 WHERE len(stack) > 0))"""
RECORDS = PATHS + BLOCK_CTES
ORACLES["doc_blocks"] = f"""WITH RECURSIVE {RECORDS} SELECT rec_id AS doc_id, source, doc_id AS part, ordinal, content_type, length(raw_text) AS char_count,
  array_to_string(stack, ' > ') AS section_path, md5(raw_text) AS text_md5 FROM rec"""


def split_level(source: str, level: int, mark: str) -> tuple[str, str]:
    """One separator: open pieces that hold it fall into parts; long parts stay open for finer ones."""
    name, m = f"s{level}", f"'{mark}'" if mark != "\n" else "chr(10)"
    m = "chr(10) || chr(10)" if mark == "\n\n" else m
    return name, f"""
{name}p AS (SELECT rec_id, grp, path, parent, unnest(string_split(t, {m})) AS r, unnest(range(len(string_split(t, {m})))) AS k FROM {source} WHERE still AND contains(t, {m})),
{name} AS (SELECT * FROM {source} WHERE NOT (still AND contains(t, {m}))
    UNION ALL SELECT rec_id, grp, list_append(path, k) AS path, path AS parent, CASE WHEN k = 0 THEN r ELSE {m} || r END AS t,
      length(CASE WHEN k = 0 THEN r ELSE {m} || r END) >= {L.CHUNK_SIZE} AS still FROM {name}p WHERE k > 0 OR r <> '')"""


def packed(source: str, name: str) -> str:
    """Greedy groups of consecutive items (rec_id, k, t) of at most one chunk size."""
    return f"""
{name}l AS (SELECT rec_id, list({{'n': k, 'size': length(t), 'cuts': CAST([] AS BIGINT[])}} ORDER BY k) AS xs FROM {source} GROUP BY rec_id),
{name}f AS (SELECT rec_id, list_reduce(xs, lambda a, x: CASE WHEN a.size + x.size > {L.CHUNK_SIZE} THEN {{'n': x.n, 'size': x.size, 'cuts': list_append(a.cuts, x.n)}}
      ELSE {{'n': x.n, 'size': a.size + x.size, 'cuts': a.cuts}} END).cuts AS cuts FROM {name}l),
{name} AS (SELECT rec_id, len([c FOR c IN cuts IF c <= k]) AS g, string_agg(t, chr(10) ORDER BY k) AS t FROM {source} JOIN {name}f USING (rec_id) GROUP BY 1, 2)"""


def chunk_ctes() -> str:
    """Pieces (rec_id, chunk_index, text) of the records in rec, by the rules of each type."""
    rows = f"""
tb AS (SELECT rec_id, string_split(raw_text, chr(10)) AS ls FROM rec WHERE content_type = 'table' AND length(raw_text) > {L.MAX_TABLE_CHARS}),
th AS (SELECT rec_id, ls, CASE WHEN len(ls) > 1 AND regexp_matches(trim(ls[2], {WS}), '{L.TABLE_SEPARATOR_PATTERN}') THEN 2 ELSE 1 END AS h FROM tb),
ti AS (SELECT rec_id, unnest(ls[h + 1:]) AS t, unnest(range(1, len(ls) - h + 1)) AS k FROM th),{packed('ti', 'tp')},
ll AS (SELECT rec_id, unnest(string_split(raw_text, chr(10))) AS line, unnest(range(len(string_split(raw_text, chr(10))))) AS j FROM rec WHERE content_type = 'list' AND length(raw_text) > {L.CHUNK_SIZE}),
lk AS (SELECT *, sum(CASE WHEN j = 0 OR regexp_matches(line, '{L.LIST_ITEM_PATTERN}') THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY j) AS k FROM ll),
li AS (SELECT rec_id, k, string_agg(line, chr(10) ORDER BY j) AS t FROM lk GROUP BY 1, 2),{packed('li', 'lp')},
s0 AS (SELECT rec_id, CAST(g AS BIGINT) AS grp, CAST([] AS BIGINT[]) AS path, CAST(NULL AS BIGINT[]) AS parent, t, true AS still FROM lp
    UNION ALL SELECT rec_id, 0, [], NULL, raw_text, true FROM rec WHERE content_type = 'text' AND length(raw_text) > {L.CHUNK_SIZE})"""
    name = "s0"
    for level, mark in enumerate(L.SEPARATORS[:-1], 1):
        name, step = split_level(name, level, mark)
        rows += "," + step
    return rows + f""",
lf AS (SELECT rec_id, grp, path, parent, t FROM {name} WHERE NOT still
    UNION ALL SELECT rec_id, grp, list_append(path, k) AS path, path AS parent, substring(t, k + 1, 1) FROM (
      SELECT *, unnest(range(length(t))) AS k FROM {name} WHERE still)),
lo AS (SELECT *, row_number() OVER w AS n, lag(parent) OVER w AS before FROM lf WINDOW w AS (PARTITION BY rec_id, grp ORDER BY path)),
ls AS (SELECT *, sum(CASE WHEN n > 1 AND parent = before THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, grp ORDER BY n) AS seg FROM lo),
sg AS (SELECT rec_id, grp, seg, string_agg(t, '' ORDER BY n) AS whole, list(length(t) ORDER BY n) AS sizes FROM ls GROUP BY 1, 2, 3),
sp AS (SELECT *, list_transform(range(len(sizes) + 1), lambda k: coalesce(list_sum(sizes[1:k]), 0)) AS p FROM sg),
sx AS (SELECT rec_id, grp, seg, whole, p, list_transform(sizes, lambda z, j: {{'n': j, 'l': z, 's': CAST(1 AS BIGINT), 'cuts': CAST([] AS BIGINT[][])}}) AS xs FROM sp),
sf AS (SELECT rec_id, grp, seg, whole, p, list_reduce(xs, lambda a, x: CASE WHEN p[x.n] - p[a.s] + x.l > {L.CHUNK_SIZE} AND a.s < x.n
      THEN {{'n': x.n, 'l': x.l, 's': list_min([z FOR z IN range(a.s, x.n + 1) IF p[x.n] - p[z] <= {L.CHUNK_OVERLAP} AND (p[x.n] = p[z] OR p[x.n] - p[z] + x.l <= {L.CHUNK_SIZE})]),
            'cuts': list_append(a.cuts, [a.s, x.n])}}
      ELSE {{'n': x.n, 'l': x.l, 's': a.s, 'cuts': a.cuts}} END) AS e FROM sx),
sc AS (SELECT rec_id, grp, seg, whole, p, unnest(list_append(e.cuts, [e.s, CAST(e.n + 1 AS BIGINT)])) AS c, unnest(range(len(e.cuts) + 1)) AS o FROM sf),
st2 AS (SELECT rec_id, grp, seg, o, trim(substring(whole, CAST(p[c[1]] + 1 AS BIGINT), CAST(p[c[2]] - p[c[1]] AS BIGINT)), {WS}) AS t FROM sc),
pieces AS (
    SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY grp, seg, o) - 1 AS chunk_index, t AS text FROM st2 WHERE t <> ''
    UNION ALL SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY g) - 1, array_to_string(ls[1:h], chr(10)) || chr(10) || t FROM tp JOIN th USING (rec_id)
    UNION ALL SELECT rec_id, 0, raw_text FROM rec WHERE (content_type = 'table' AND length(raw_text) <= {L.MAX_TABLE_CHARS}) OR (content_type = 'list' AND length(raw_text) <= {L.CHUNK_SIZE})
    UNION ALL SELECT rec_id, 0, trim(raw_text, {WS}) FROM rec WHERE content_type = 'text' AND length(raw_text) <= {L.CHUNK_SIZE} AND trim(raw_text, {WS}) <> '')"""


CHUNKS = CLEAN + "," + line_ctes("pc") + HEADINGS + BLOCK_CTES + "," + chunk_ctes()
ORACLES["chunks"] = f"""WITH RECURSIVE {CHUNKS} SELECT md5(rec_id || '::' || chunk_index || '::' || substring(pieces.text, 1, 64)) AS chunk_id, rec_id AS doc_id, pieces.text AS text, source,
  CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'markdown' END AS file_type, array_to_string(stack, ' > ') AS section_path, content_type, length(pieces.text) AS char_count,
  CAST(doc_id AS VARCHAR) AS page, '' AS sheet_name FROM pieces JOIN rec USING (rec_id)"""
ORACLES["chunk_upsert"] = f"""WITH RECURSIVE {CHUNKS} SELECT source, content_type, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT DISTINCT rec_id, chunk_index, pieces.text AS text, source, content_type FROM pieces JOIN rec USING (rec_id)) GROUP BY 1, 2"""
oracle("csv_segments", T + """,
v0 AS (SELECT device_id || '.csv' AS source, rn + 1 AS row_no, operating_state AS s, strftime(timestamp, '%H:%M:%S') || ' | ' || printf('%.2f', temp_de) || ' | ' || operating_state AS line FROM t),
v1 AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY source ORDER BY row_no) THEN 1 ELSE 0 END AS c FROM v0),
v2 AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY row_no) AS seg FROM v1),
v3 AS (SELECT *, (row_number() OVER (PARTITION BY source, seg ORDER BY row_no) - 1) // 50 AS piece FROM v2)""",
       """SELECT source, min(row_no) AS part, any_value(s) AS segment_value, count(*) AS row_count,
  md5('timestamp | temp_de | operating_state' || chr(10) || string_agg(line, chr(10) ORDER BY row_no)) AS text_md5 FROM v3 GROUP BY source, seg, piece""")
oracle("sheet_text", "", """SELECT source, md5(z) AS text_md5, length(z) AS chars FROM (SELECT l_orderkey AS source,
  string_agg(l_partkey || ' | ' || l_returnflag || CASE WHEN l_linestatus = 'F' THEN '' ELSE ' | ' || l_linestatus END, chr(10)
    ORDER BY l_linenumber || '/' || l_partkey, l_partkey || ' | ' || l_returnflag || CASE WHEN l_linestatus = 'F' THEN '' ELSE ' | ' || l_linestatus END) AS z FROM lineitem GROUP BY 1)""")

oracle("user_value_cv", """u0 AS (SELECT user_id, value, CASE WHEN count(*) OVER f >= 12 THEN stddev_samp(value) OVER f / avg(value) OVER f * 100 ELSE 0 END AS c1,
    CASE WHEN count(*) OVER f >= 12 THEN stddev_samp(value + 100) OVER f / avg(value + 100) OVER f * 100 ELSE 0 END AS c2
  FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""", f"""
SELECT user_id, CAST(0 AS BIGINT) AS seg_index, count(*) AS data_points, {rnd('avg(value)', 2)} AS avg_flow, {rnd('coalesce(stddev_samp(value) / avg(value) * 100, 0)', 2)} AS cv_flow,
  {rnd('max(c1)', 2)} AS cv_flow_peak, {rnd('max(c2)', 2)} AS cv_press_peak FROM u0 GROUP BY 1""")


# ---- readers, small functions ------------------------------------------------------------------

FRAME_COLUMNS = ", ".join(L.READINGS)
oracle("device_history", T, f"SELECT device_id, {iso('timestamp')} AS timestamp, {FRAME_COLUMNS}, operating_state, alarm_code FROM t WHERE dev = 0")
oracle("device_window", T, f"""SELECT {iso('timestamp')} AS timestamp, {FRAME_COLUMNS}, operating_state, alarm_code FROM t
  WHERE dev = 0 AND timestamp BETWEEN TIMESTAMP '2026-09-13 00:05:00' AND TIMESTAMP '2026-09-13 04:05:00'""")
oracle("plain_numbers", "", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN {rnd('l_extendedprice / l_discount', 3)} END AS price_per_discount FROM lineitem""")
IMAGE_BYTES = """CASE doc_id % 5 WHEN 0 THEN unhex('FFD8FF00') WHEN 1 THEN unhex('89504E470D0A1A0A') WHEN 2 THEN unhex('474946383961') WHEN 3 THEN unhex('524946460000000057454250') ELSE encode('BM') END || encode(text)"""
oracle("image_uris", "", f"""SELECT doc_id, mime, sha256(content) AS sha256, md5('data:' || mime || ';base64,' || base64(content)) AS url_md5 FROM (
  SELECT doc_id, {IMAGE_BYTES} AS content, [ 'image/jpeg', 'image/png', 'image/gif', 'image/webp', NULL][doc_id % 5 + 1] AS mime FROM documents)""")
oracle("segment_views", SEG, f"SELECT device_id, seg_index, state, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM seg")
oracle("l2_cosine", "", f"""SELECT a.vec_id, {rnd('greatest(-1, least(1, 1 - list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))]) / 2))', 5)} AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 7 * 7""")
oracle("unfinished_cases", CASES + "," + PHOTOS, "SELECT trace_id, device_id FROM cs WHERE trace_id NOT IN (SELECT trace_id FROM vs)")
oracle("attached_images", CASES + "," + PHOTOS, f"""SELECT trace_id, pos, image_id,
  CASE WHEN pos % 2 = 0 THEN CASE WHEN failed THEN '（本图识别失败，未产生视觉结论：timeout）' WHEN n % 6 = 0 THEN '' ELSE '照片 ' || kind END ELSE '{L.FAILED_PREFIX}，未产生视觉结论：no result）' END AS description,
  CASE WHEN pos % 2 = 1 THEN '处理失败：no result' WHEN n % 4 = 0 THEN '反光;  ' ELSE '' END AS limitations
  FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS place FROM ph)""".replace("trace_id, pos, image_id", "trace_id, place AS pos, image_id").replace("pos % 2", "place % 2"))
oracle("repeated_queries", "", """SELECT case_id, md5(text) AS query_md5, min(turn) AS query_pos FROM (
  SELECT conv_id AS case_id, turn, trim(text) AS text FROM conversations) WHERE text <> '' GROUP BY 1, text""")
oracle("retry_cases", "", """SELECT case_id, consulted AND error = '' AND NOT sufficient AND turns > 2 AS retry,
  CASE WHEN NOT consulted THEN '' WHEN error <> '' THEN chr(10) || chr(10) || '⚠️ 说明：本次检索结果**未经审阅**（审阅环节不可用），覆盖可能不完整。若片段不足以回答，请如实告知用户，不要凭已有知识补充。'
    WHEN sufficient THEN '' ELSE chr(10) || chr(10) || '⚠️ 审阅结论：上述片段**不足以完整回答**该问题，缺少：' || CASE WHEN turns > 3 THEN 'a；b' ELSE '部分信息' END
    || '。已尝试补查但仍未覆盖。请**如实告知用户哪部分知识库中没有**，不要把现有片段当成完整资料作答，更不要凭已有知识补齐。' END AS note FROM (
  SELECT conv_id AS case_id, count(*) AS turns, conv_id % 5 <> 0 AS consulted, CASE WHEN conv_id % 7 = 0 THEN 'x' ELSE '' END AS error, conv_id % 3 = 0 AS sufficient FROM conversations GROUP BY conv_id)""")
ORACLES["build_report"] = f"""WITH RECURSIVE {CHUNKS} SELECT 20 AS files_scanned, (SELECT count(*) FROM pc) AS docs_loaded, (SELECT count(*) FROM rec) AS records,
  count(*) AS chunks_created, count(DISTINCT md5(rec_id || '::' || chunk_index || '::' || substring(pieces.text, 1, 64))) AS chunks_written FROM pieces"""
