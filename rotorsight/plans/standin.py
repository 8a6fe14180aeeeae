"""Telemetry, cases and photo observations derived from the generic driver tables.

The driver's tables hold no pump telemetry, so ``events`` stands in: each event becomes one frame.
The mapping is row-local. Every third event belongs to one device, so that device always holds a
third of all rows, whatever the scale; the other devices have 960 frames each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import limits as L
from ..functions.scalars import alarm_from_readings

BASE_SECONDS = 1789257725      # 2026-09-13 00:02:05 UTC
CASE_SECONDS = 240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(events: DataFrame) -> DataFrame:
    """Frames every 5 s per device, cycling through eight phases of 48 frames."""
    hot = F.expr("event_id % 3 = 0")
    other = F.expr("(event_id div 3) * 2 + event_id % 3 - 1")
    placed = events.select(
        "event_id", "event_type", "value",
        F.when(hot, F.lit(0)).otherwise(1 + F.floor(other / 960)).cast("long").alias("dev"),
        F.when(hot, F.expr("event_id div 3")).otherwise(other % 960).cast("long").alias("rn"),
        (F.floor("value").cast("long") % 11 - 5).alias("j"))
    phased = placed.withColumns({
        "p": F.col("rn") % 48,
        "ph": (F.floor(F.col("rn") / 48).cast("long") + F.col("dev")) % 8,
        "timestamp": F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("rn") * 5),
        "device_id": F.concat(F.lit("PUMP-IS100-"), F.format_string("%05d", "dev"))})
    joined = phased.join(F.broadcast(phases(events.sparkSession)), "ph")
    # Three decimals by integer arithmetic: round() on doubles goes through BigDecimal.
    reading = lambda c: F.floor((F.col(f"{c}_0") + F.col(f"{c}_j") * F.col("j")
                                 + F.col(f"{c}_p") * F.col("p")) * 1000 + 0.5) / 1000
    frames = joined.withColumns({c: reading(c) for c in L.READINGS})
    return frames.withColumn(
        "alarm_code", alarm_from_readings(F.col("operating_state") == L.SHUTDOWN)).select(
        *L.TELEMETRY_COLUMNS, "event_type", "value", "rn", "dev")


# Per phase and reading: value, change per step of j, change per frame p. Fixed, eight rows.
STEADY = {"flow_rate": (100, 0.2, 0), "press_out": (0.312, 0, 0), "press_in": (0.02, 0, 0),
          "temp_de": (45, 0.1, 0), "temp_nde": (43, 0, 0), "vib_rms_de": (1.45, 0.01, 0),
          "vib_rms_nde": (1.35, 0, 0), "motor_current": (22.5, 0, 0)}
PHASES = [
    ("NORMAL", {}),
    ("DEGRADING", {"temp_de": (60, 0, 0.03), "vib_rms_de": (2.5, 0, 0)}),
    ("WARNING", {"temp_de": (68, 0, 0.3), "temp_nde": (55, 0, 0), "vib_rms_de": (3.6, 0, 0.03),
                 "vib_rms_nde": (2.9, 0, 0)}),
    ("TRIP_SHUTDOWN", {"flow_rate": (0.05, 0, 0), "press_out": (0.001, 0, 0),
                       "press_in": (0, 0, 0), "temp_de": (60, 0, -0.3), "vib_rms_de": (0.1, 0, 0),
                       "vib_rms_nde": (0.05, 0, 0), "motor_current": (0.05, 0, 0)}),
    ("CRITICAL_CAVITATION", {"flow_rate": (75, 3, 0), "press_out": (0.25, 0, 0),
                             "press_in": (-0.045, 0.003, 0), "vib_rms_de": (5.4, 0, 0),
                             "vib_rms_nde": (5.1, 0, 0), "motor_current": (19, 0, 0)}),
    ("WARNING", {"temp_de": (72, 0.01, 0), "temp_nde": (60, 0, 0), "vib_rms_de": (3.8, 0, 0),
                 "vib_rms_nde": (3.9, 0, 0), "motor_current": (30, 0, 0)}),
    ("UNBALANCE_MISALIGNMENT", {"vib_rms_de": (2.5, 0, 0), "vib_rms_nde": (5.5, 0, 0),
                                "motor_current": (15.5, 0, 0)}),
    ("NORMAL", {"flow_rate": (42, 0.1, 0), "press_out": (0.131, 0, 0)}),
]


def phases(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        f"({ph}L, '{state}', " + ", ".join(f"{float(x)}D" for c in L.READINGS
                                           for x in {**STEADY, **own}[c]) + ")"
        for ph, (state, own) in enumerate(PHASES))
    names = ", ".join(["ph", "operating_state"]
                      + [f"{c}_{part}" for c in L.READINGS for part in ("0", "j", "p")])
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({names})")


def load_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(table(spark, sf_dir, "events"))


# ---- cases and photos ------------------------------------------------------------------------------

NOTES = ["", "驱动端轴承温度偏高", "机封处有漏液", "入口压力低，疑似气蚀", "   ", "routine check"]
DEFECTS = {"click": "LEAK", "error": "CRACK", "purchase": "SCALE", "signup": "WEAR",
           "view": "leak "}


def _case_windows(frames: DataFrame, *extra: str) -> DataFrame:
    keyed = frames.withColumn("b", F.expr(f"unix_seconds(timestamp) div {CASE_SECONDS}"))
    return keyed.groupBy("device_id", "dev", "b", *extra).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("mv")).withColumns({
            "k": F.col("b") + F.col("dev"),
            "trace_id": F.concat("device_id", F.lit("-"), F.col("b").cast("string"))})


def cases(frames: DataFrame) -> DataFrame:
    """One case per device and four minutes; some lack a device, a window or a note."""
    at = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("k")
    no_window = k % 7 == 3
    return _case_windows(frames).select(
        "trace_id", F.when(k % 11 == 5, "").otherwise(F.col("device_id")).alias("device_id"),
        F.when(no_window, "").otherwise(at(F.col("b") * CASE_SECONDS)).alias("start_time"),
        at((F.col("b") + 1) * CASE_SECONDS).alias("end_time"),
        F.timestamp_seconds((F.col("b") + 1) * CASE_SECONDS + 600).alias("reported_at"),
        F.element_at(F.array(*[F.lit(n) for n in NOTES]), (k % 6 + 1).cast("int"))
        .alias("user_query"),
        F.when(k % 4 == 1, "bearing high").when(k % 4 == 2, "TAH-101").when(k % 4 == 3, "")
        .alias("alarm_code"),
        F.when(k % 5 == 2, F.array(F.lit("vision"))).otherwise(F.array().cast("array<string>"))
        .alias("degraded_steps"))


def images(frames: DataFrame) -> DataFrame:
    """One photo per case and event type, for two cases out of three."""
    k, mv, n, kind = F.col("k"), F.col("mv"), F.col("n"), F.col("event_type")
    defects = F.create_map(*[F.lit(x) for kv in DEFECTS.items() for x in kv])
    failed = k % 13 == 4
    observation = F.struct(
        F.when(kind == "purchase", "").otherwise(F.concat(F.lit("part-"), kind)).alias("target"),
        F.concat(F.lit("seen "), kind).alias("finding"),
        F.when(mv > 100, "abnormal").when(mv > 70, "normal").otherwise("unknown")
        .alias("polarity"),
        F.element_at(defects, kind).alias("defect_type"),
        F.when(mv > 160, "SEVERE").when(mv > 130, "MODERATE").when(mv > 105, "MINOR")
        .alias("severity"),
        F.least(F.lit(1.0), mv / 200).alias("confidence"),
        F.when(n % 5 == 0, "").otherwise(F.concat(kind, F.lit(" x"), n.cast("string")))
        .alias("evidence"))
    none = F.array().cast("array<struct<target:string,finding:string,polarity:string,"
                          "defect_type:string,severity:string,confidence:double,evidence:string>>")
    return _case_windows(frames, "event_type").filter(k % 3 != 1).select(
        "trace_id", (F.array_position(F.array(*[F.lit(x) for x in sorted(DEFECTS)]), kind) - 1)
        .alias("pos"),
        F.when(kind == "signup", "").otherwise(F.concat("trace_id", F.lit("/"), kind))
        .alias("image_id"),
        F.concat(F.lit("https://photos.example/"), "device_id", F.lit("/"), kind, F.lit(".png"))
        .alias("uri"),
        F.when(failed, "（本图识别失败，未产生视觉结论：timeout）").when(n % 6 == 0, "")
        .otherwise(F.concat(F.lit("照片 "), kind)).alias("description"),
        F.when(n % 4 == 0, F.array(F.lit("反光"), F.lit(" ")))
        .otherwise(F.array().cast("array<string>")).alias("limitations"),
        F.when(failed, none).otherwise(F.array(observation)).alias("observations"))


CLAUSES = [
    ("DEMO-MANUAL", "bearing-01", "1. 驱动端轴承温振异常", "驱动端轴承温度达到80℃或振动达到4.5mm/s触发停机线。", 3,
     ["BEARING_TEMP_DE_WARN", "BEARING_TEMP_DE_TRIP", "VIB_DE_WARN", "VIB_DE_TRIP"], ["轴承"],
     "达到停机线时应隔离设备。", "隔离、冷却后检查润滑状态与游隙。", "轴承与润滑异常可伴随温度、振动同步升高。"),
    ("DEMO-MANUAL", "cavitation-01", "2. 气蚀", "入口压力降低或流量显著波动时应核验吸入条件。", None,
     ["PRESS_IN_TRIP", "CV_UNSTABLE"], ["气蚀"], None, None, None),
    ("DEMO-MANUAL", "seal-01", "3. 密封", "机械密封允许微量外渗。", 5, [], ["漏", "机封"], None,
     "更换机械密封。", "密封面贴合失效。"),
    ("DEMO-MANUAL", "motor-01", "4. 电机", "持续过流会烧毁绝缘。", 7, ["CURRENT_HIGH", "CURRENT_LOW"],
     ["check", "TAH"], "核对负载。", None, None),
]


def clauses(spark: SparkSession) -> DataFrame:
    from ..sources.config import CLAUSE_SCHEMA
    return spark.createDataFrame(CLAUSES, CLAUSE_SCHEMA)


# ---- retrieval -------------------------------------------------------------------------------------

def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding",
        F.concat(F.lit("chapter "), F.col("label").cast("string")).alias("section_path"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("sheet_name"))


def chunk_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of the same number supplies text and source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text",
        F.concat(F.lit("/manuals/"), "source", F.lit(".md")).alias("source"))


def centroid_queries(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Per label (= case) the unit centroids of ``parts`` groups of its vectors, as queries."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("case_id"), (F.col("vec_id") % parts).alias("query_pos"),
        F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("case_id", "query_pos", "i").agg(F.avg("x").alias("x")).groupBy(
        "case_id", "query_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                                lambda p: p["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return means.withColumn("norm", norm).select(
        "case_id", "query_pos", F.format_string("label %d part %d", "case_id", "query_pos")
        .alias("query_text"), F.transform("v", lambda x: x / F.col("norm")).alias("query_vec"))


def closeness(hits: DataFrame):
    """Stand-in pair score: one minus the mean absolute difference of all components."""
    gaps = F.zip_with("query_vec", "embedding", lambda a, b: F.abs(a - b.cast("double")))
    return 1 - F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size("query_vec")


# ---- documents ---------------------------------------------------------------------------------

def manual_pages(documents: DataFrame) -> DataFrame:
    """Documents as pages of their source, with structure added to some of their lines.

    The driver's texts have no headings, lists or tables. A fixed rule on document and line number
    puts a heading, a separator or an empty line before some lines and makes others list items or
    table rows. Every line itself stays whole: nothing is shortened or replaced.
    """
    lines = F.split("text", "\n")
    words = lambda x: F.regexp_replace(F.substring(x, 1, 12), "[^A-Za-z ]", "")

    def dressed(line, i):
        h = (F.col("doc_id") * 7 + i * 13) % 17
        marked = F.col("doc_id") % 3 != 0
        before = lambda x: F.concat(x, F.lit("\n"), line)
        level = lambda md, plain: before(
            F.when(marked, F.concat(F.lit(md), F.substring(line, 1, 20)))
            .otherwise(F.concat(F.lit(plain), words(line))))
        return (F.when(h == 0, level("# ", "1 x")).when(h == 1, level("## ", "2 x"))
                .when(h == 2, level("### ", "3 x"))
                .when(h == 3, before(F.concat((i % 5).cast("string"), F.lit(".2 x"), words(line))))
                .when(h == 4, F.concat(F.lit("- "), line))
                .when(h == 5, F.concat(F.lit("| "), line, F.lit(" |")))
                .when(h == 6, before(F.lit("|---|---|"))).when(h == 7, before(F.lit("")))
                .when(h == 8, before(F.lit("附录A 标题"))).otherwise(line))

    return documents.select(
        "source", F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("markdown").alias("file_type"),
        F.col("doc_id").alias("part"), F.col("doc_id").cast("int").alias("page"),
        F.lit(None).cast("string").alias("sheet_name"),
        F.array_join(F.transform(lines, dressed), "\n").alias("text"))


def csv_rows(frames: DataFrame) -> DataFrame:
    """Telemetry as rows of one CSV file per device, each with the file's header."""
    names = ["timestamp", "temp_de", "operating_state"]
    return frames.select(
        F.concat("device_id", F.lit(".csv")).alias("source"), (F.col("rn") + 1).alias("row_no"),
        F.array(F.date_format("timestamp", "HH:mm:ss"),
                F.format_string("%.2f", "temp_de"), F.col("operating_state")).alias("cells"),
        F.array(*[F.lit(n) for n in names]).alias("header"))
