"""Registered queries: name -> function(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import limits as L
from ..functions.scalars import (alarm_from_readings, data_url, image_type, iso, plain_number,
                                 stable_round)
from ..functions import text as TX
from ..operators import (alarms as A, attribution, cases as C, chunking, delivery as D,
                         documents as P, manual as K,
                         measures as M, provenance as PV, retrieval as Q, rules as R, runs as U,
                         safety, segments as S,
                         terms as T, vector_index as VI, vision as V)
from ..session import configure, materialise, shared_folder
from ..sources import documents as DS, telemetry as TS
from ..sources.config import RiskConfig, risk_matrix
from . import diagnosis as X, knowledge, search, standin as N

QUERIES = {}


def query(fn):
    """Register under the function's own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def longs(df: DataFrame) -> DataFrame:
    """Integers as 64 bit, timestamps as ISO text, string arrays joined by ';'."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif kind in ("timestamp", "timestamp_ntz"):
            out.append(iso(f.name).alias(f.name))
        elif kind == "array<string>":
            out.append(F.array_join(f.name, ";").alias(f.name))
        elif kind == "date":
            out.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def device_segments(spark, sf_dir):
    runs = S.telemetry_runs(N.load_telemetry(spark, sf_dir))
    return runs, R.judge(S.segment_metrics(runs))


def shared_segments(spark, sf_dir):
    """Segments written once, for queries that read them in more than one branch."""
    runs, seg = device_segments(spark, sf_dir)
    return runs, materialise(seg)


@query
def segment_metrics(spark, sf_dir):
    _, seg = device_segments(spark, sf_dir)
    return longs(seg.select(
        "device_id", "seg_index", "state", F.col("start").alias("start_time"),
        F.col("end").alias("end_time"), "duration_sec", "data_points", "avg_flow", "avg_press_out",
        "avg_press_in", "max_temp_de", "max_temp_nde", "max_vib_de", "max_vib_nde",
        "avg_motor_current", "max_motor_current"))


@query
def segment_cv_slope(spark, sf_dir):
    _, seg = device_segments(spark, sf_dir)
    return longs(seg.select("device_id", "seg_index", "cv_flow", "cv_press", "slope_temp_de",
                            "slope_vib_de"))


@query
def rolling_cv_peak(spark, sf_dir):
    _, seg = device_segments(spark, sf_dir)
    return longs(seg.select("device_id", "seg_index", "cv_flow_peak", "cv_press_peak"))


@query
def ramp_start(spark, sf_dir):
    _, seg = device_segments(spark, sf_dir)
    return longs(seg.select("device_id", "seg_index", "ramp_start_time"))


@query
def segment_rule_hits(spark, sf_dir):
    _, seg = device_segments(spark, sf_dir)
    return longs(R.hit_rows(seg, R.rule_catalog(spark))
                 .select("device_id", "seg_index", "code", "label", "sentence"))


@query
def window_rule_codes(spark, sf_dir):
    _, seg = shared_segments(spark, sf_dir)
    return longs(R.window_codes(seg, ["device_id"]))


@query
def overall_view(spark, sf_dir):
    runs, seg = shared_segments(spark, sf_dir)
    return longs(S.overall_metrics(runs, seg).drop("window_start", "window_end")
                 .withColumn("avg_flow", stable_round("avg_flow", 6)))


@query
def measurements_long(spark, sf_dir):
    runs, seg = shared_segments(spark, sf_dir)
    rows = M.measurements(seg, S.overall_metrics(runs, seg), ["device_id"])
    return longs(rows.select(
        "device_id", "name", F.when(F.col("segment") == "overall", stable_round("value", 6))
        .otherwise(F.col("value")).alias("value"), "unit", "segment", "start_time"))


@query
def overall_measurements(spark, sf_dir):
    runs, seg = shared_segments(spark, sf_dir)
    rows = M.measurements(seg, S.overall_metrics(runs, seg), ["device_id"])
    names = ["max_temp_de", "max_vib_de", "max_vib_nde", "avg_flow", "min_press_in",
             "total_points"]
    return M.lookup(rows, ["device_id"], names).withColumn("avg_flow", stable_round("avg_flow", 6))


@query
def alarm_sets(spark, sf_dir):
    return longs(A.alarm_sets(N.load_telemetry(spark, sf_dir), ["device_id"]))


@query
def alarm_from_readings_(spark, sf_dir):
    frames = N.load_telemetry(spark, sf_dir)
    return longs(frames.select("device_id", "timestamp", alarm_from_readings(
        F.col("operating_state") == L.SHUTDOWN).alias("alarm_code")))


QUERIES["alarm_from_readings"] = QUERIES.pop("alarm_from_readings_")


@query
def state_distribution(spark, sf_dir):
    return longs(A.state_distribution(N.load_telemetry(spark, sf_dir), ["device_id"]))


@query
def alarm_counts(spark, sf_dir):
    return longs(A.alarm_counts(N.load_telemetry(spark, sf_dir), ["device_id"]))


@query
def day_labels(spark, sf_dir):
    return longs(A.day_labels(N.load_telemetry(spark, sf_dir), ["device_id"]))


@query
def state_alarm_conflicts(spark, sf_dir):
    frames = N.load_telemetry(spark, sf_dir).withColumn("alarm_code", alarm_from_readings())
    return longs(A.state_alarm_conflicts(frames).groupBy(
        "device_id", "operating_state", F.col("alarm_code").alias("alarm"))
        .agg(F.count(F.lit(1)).alias("frames")))


@query
def state_hysteresis(spark, sf_dir):
    frames = N.load_telemetry(spark, sf_dir)
    warning, normal = F.col("operating_state") == "WARNING", F.col("operating_state") == "NORMAL"
    intent = (F.when(warning & (F.col("rn") % 5 < 2), "DEGRADING").when(warning, "NORMAL")
              .when(normal & (F.col("dev") % 3 == 0), "NORMAL")
              .otherwise(F.col("operating_state")))
    warmer = F.when(F.col("rn") % 97 < 40, 21).otherwise(0)
    frames = frames.withColumns({"phase_intent": intent, "temp_de": F.col("temp_de") + warmer})
    return longs(A.resolve_states(frames).select("device_id", "timestamp", "alarm", "state"))


@query
def event_segments(spark, sf_dir):
    events = N.table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    series = U.Series(keys=("user_id",), ts="ts", state="event_type", slice_seconds=86400, block=8)
    seg = U.segments_of_states(events, series)
    return longs(seg.select("user_id", "seg_index", "state", F.col("start").alias("start_time"),
                            F.col("end").alias("end_time"), "data_points"))


# ---- cases -----------------------------------------------------------------------------------------

def case_inputs(spark, sf_dir):
    frames = N.load_telemetry(spark, sf_dir)
    return N.cases(frames), frames, N.images(frames)


def verdicts(spark, sf_dir):
    return X.diagnose(*case_inputs(spark, sf_dir))


def joined(column, field=None, sep=";"):
    value = F.col(column) if field is None else F.transform(column, lambda x: x[field])
    return F.array_join(value, sep)


@query
def case_windows(spark, sf_dir):
    cases, frames, _ = case_inputs(spark, sf_dir)
    placed = C.default_windows(cases)
    inside = C.case_frames(placed, frames).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("frames"), F.min("timestamp").alias("first_frame"),
        F.max("timestamp").alias("last_frame"))
    return longs(placed.join(inside, "trace_id", "left").select(
        "trace_id", "device_id", "start_time", "end_time",
        F.coalesce("frames", F.lit(0)).alias("frames"), "first_frame", "last_frame"))


@query
def case_input_digests(spark, sf_dir):
    """What each case was judged on, as hashes over all its frames, notes and photos."""
    cases, frames, images = case_inputs(spark, sf_dir)
    return longs(PV.case_digests(C.default_windows(cases), frames,
                                 photos=images.select("trace_id", "pos", "image_id")))


@query
def coverage_quality(spark, sf_dir):
    cases, frames, _ = case_inputs(spark, sf_dir)
    placed = C.default_windows(cases)
    points = C.case_frames(placed, frames).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total_points"))
    return longs(C.coverage(placed.join(points, "trace_id", "left")).select(
        "trace_id", "total_points", "expected_points",
        stable_round("coverage_pct", 6).alias("coverage_pct"), "data_status", "data_reason"))


@query
def case_evidence(spark, sf_dir):
    return longs(X.gather(*case_inputs(spark, sf_dir)).select(
        "trace_id", "data_status", "text_status", "vision_status", "total_points", "phase_count",
        "flags", "effective", "last", "start_state", "end_state", "has_shutdown", "max_temp_de",
        "max_vib_de", "max_vib_nde", "min_press_in",
        stable_round("avg_flow", 6).alias("avg_flow")))


@query
def offline_descriptions(spark, sf_dir):
    evidence = X.gather(*case_inputs(spark, sf_dir))
    return longs(C.offline_descriptions(evidence))


@query
def description_warnings(spark, sf_dir):
    evidence = X.gather(*case_inputs(spark, sf_dir))
    return longs(C.description_warnings(C.offline_descriptions(evidence), evidence))


@query
def evidence_whitelist(spark, sf_dir):
    """Names quoted by a description that really occur in the case's material."""
    evidence = X.gather(*case_inputs(spark, sf_dir))
    quoted = F.array(F.lit("max_temp_de"), F.lit("invented_metric"), F.lit("VIB_DE_TRIP"),
                     F.lit("FLOW_DEV"), F.lit("cv_flow"))
    names = F.when(F.col("total_points") > 0, F.array(*[
        F.lit(n) for n in [*L.OVERALL_UNITS, *L.SEGMENT_UNITS]])) \
        .otherwise(F.array().cast("array<string>"))
    return longs(evidence.select("trace_id", C.known_evidence(
        quoted, F.concat(names, F.col("flags"))).alias("evidence")))


@query
def findings(spark, sf_dir):
    _, _, images = case_inputs(spark, sf_dir)
    return longs(V.findings(images))


@query
def rejected_observations(spark, sf_dir):
    _, _, images = case_inputs(spark, sf_dir)
    return longs(V.rejected(images))


@query
def vision_status(spark, sf_dir):
    cases, _, images = case_inputs(spark, sf_dir)
    return longs(V.status(cases, images, V.findings(images)).select(
        "trace_id", "images", "vision_status", F.size("findings").alias("n_findings")))


@query
def vision_summary(spark, sf_dir):
    _, _, images = case_inputs(spark, sf_dir)
    return V.summaries(V.with_notes(images))


@query
def builtin_manual(spark, sf_dir):
    evidence = K.builtin_topics(X.gather(*case_inputs(spark, sf_dir)))
    return evidence.select(
        "trace_id", joined("evidences", "chunk_id").alias("chunks"),
        joined("requirements", "requirement").alias("requirements"),
        joined("actions", "action").alias("actions"), "mechanism")


@query
def clause_match(spark, sf_dir):
    evidence = X.gather(*case_inputs(spark, sf_dir))
    return longs(K.match_clauses(evidence, N.clauses(spark)).select(
        "trace_id", "rank", "doc_id", "chunk_id", "hits", "n_terms",
        stable_round("score", 6).alias("score")))


@query
def clause_evidence(spark, sf_dir):
    evidence = K.clause_evidence(X.gather(*case_inputs(spark, sf_dir)), N.clauses(spark))
    return evidence.select("trace_id", "manual_status",
                           joined("evidences", "chunk_id").alias("chunks"),
                           joined("actions", "action").alias("actions"), "mechanism")


@query
def attribution_(spark, sf_dir):
    cases = attribution.attribute(K.builtin_topics(X.gather(*case_inputs(spark, sf_dir))))
    return cases.select("trace_id", "proposal_mode", "confidence",
                        joined("evidence_sources").alias("sources"), "insufficient",
                        joined("conflicts").alias("conflicts"),
                        joined("support_refs", "id").alias("support"), "summary")


QUERIES["attribution"] = QUERIES.pop("attribution_")


@query
def verdict(spark, sf_dir):
    return verdicts(spark, sf_dir).select(
        "trace_id", "decision", "risk_level", "failure_mode", joined("rule_hits").alias("rule_hits"),
        joined("reasons", sep="|").alias("reasons"), "rule_version")


@query
def guarded_verdict(spark, sf_dir):
    """Cases with failed data, stored proposals that claim too much, and protected devices."""
    b = F.split("trace_id", "-")[3].cast("long")
    given = b % 4 == 0
    no_text = F.array().cast("array<string>")
    evidence = X.gather(*case_inputs(spark, sf_dir)).withColumns({
        "data_status": F.when(b % 9 == 1, "FAILED").otherwise(F.col("data_status")),
        "given_mode": F.when(given, "SEAL_LEAK"), "given_confidence": F.lit("LOW"),
        "given_sources": F.array(F.lit("DATA"), F.lit("VISION")),
        "given_conflicts": F.when(b % 8 == 0, F.array(F.lit("given"))).otherwise(no_text),
        "given_insufficient": b % 3 == 0})
    config = RiskConfig(high_risk_devices=["is100-00001", "00000"])
    return safety.evaluate(attribution.attribute(K.builtin_topics(evidence)), config).select(
        "trace_id", "decision", "risk_level", "failure_mode", joined("rule_hits").alias("rule_hits"),
        joined("reasons", sep="|").alias("reasons"), "rule_version")


@query
def service_levels(spark, sf_dir):
    rated = safety.with_service_level(verdicts(spark, sf_dir), risk_matrix(spark))
    return rated.groupBy("risk_level", "name", "default_decision", "sla_hours", "decision").agg(
        F.count(F.lit(1)).alias("cases"))


@query
def protected_actions(spark, sf_dir):
    return verdicts(spark, sf_dir).select(
        "trace_id", F.posexplode("actions").alias("pos", "a")).select(
        "trace_id", F.col("pos").cast("long").alias("pos"), "a.action", "a.priority",
        F.col("a.source_ref.id").alias("source_id"))


@query
def dispatch(spark, sf_dir):
    return verdicts(spark, sf_dir).select(
        "trace_id", F.substring_index("report_uri", "?", 1).alias("address"),
        (F.length("report_sha256") == 64).alias("hashed"),
        F.size("traceability").cast("long").alias("chain_length"))


@query
def evidence_chain(spark, sf_dir):
    return longs(D.chain_rows(verdicts(spark, sf_dir)))


@query
def latest_reviews(spark, sf_dir):
    """Orders as reviews: customer = case, status = outcome, priority = reviewer."""
    orders = N.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trace_id"), F.col("o_orderdate").alias("reviewed_at"),
        F.concat("o_orderpriority", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
        .alias("reviewer"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "REWORK")
        .otherwise("REJECTED").alias("decision"))
    return longs(D.latest_reviews(orders))


@query
def telemetry_violations(spark, sf_dir):
    """Frames read as text, with faults put in by position."""
    frames = N.load_telemetry(spark, sf_dir)
    n = F.col("rn")
    dirty = frames.withColumns({
        "temp_de": F.when(n % 101 == 7, "n/a").when(n % 103 == 9, "NaN")
        .otherwise(F.col("temp_de").cast("string")),
        "press_in": F.when(n % 107 == 3, None).otherwise(F.col("press_in").cast("string")),
        "operating_state": F.when(n % 109 == 4, "OFFLINE").otherwise(F.col("operating_state")),
        "timestamp": F.date_format(F.when(n % 113 == 5, F.col("timestamp") - F.expr(
            "INTERVAL 5 SECONDS")).otherwise(F.col("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")})
    return longs(TS.violations(dirty))


# ---- retrieval -------------------------------------------------------------------------------------

def search_result(spark, sf_dir, parts=4):
    return search.retrieve(N.chunk_vectors(spark, sf_dir), N.centroid_queries(spark, sf_dir, parts),
                           N.closeness, details=N.chunk_details(spark, sf_dir))


@query
def topk_cosine(spark, sf_dir):
    vectors = N.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    found = Q.top_k(vectors, N.centroid_queries(spark, sf_dir, 4), L.DEFAULT_TOP_K)
    return longs(found.select("case_id", "query_pos", "chunk_id", "rank",
                              stable_round("score", 6).alias("score")))


def indexed_search(spark, sf_dir, n_lists, n_probe=None):
    """Every hundredth vector against an index of all of them; probes as the recall needs."""
    vectors = N.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    index = VI.build(vectors, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", n_lists)
    queries = vectors.filter("chunk_id % 100 = 0").select(
        F.col("label").cast("long").alias("case_id"), F.col("chunk_id").alias("query_pos"),
        F.col("embedding").cast("array<double>").alias("query_vec"))
    if n_probe is None:
        n_probe = VI.enough_probes(index, vectors, queries, L.DEFAULT_RECALL_K)
    found = VI.search(index, queries, L.DEFAULT_RECALL_K, n_probe)
    return longs(found.select("case_id", "query_pos", "chunk_id", "rank",
                              stable_round("score", 6).alias("score")))


@query
def indexed_top_k(spark, sf_dir):
    """As many lists per query as a measured recall of 95 % needs; tests measure the result."""
    return indexed_search(spark, sf_dir, 32)


@query
def indexed_exhaustive(spark, sf_dir):
    """With all lists probed, codes and re-scoring give the exact result."""
    return indexed_search(spark, sf_dir, 32, 32)


@query
def term_documents(spark, sf_dir):
    """In how many documents each word of the benchmark occurs as a part of the text."""
    words = N.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("term"))
    found = T.found_terms(N.table(spark, sf_dir, "documents"), "doc_id", F.col("text"),
                          words.filter(F.length("term") >= 6))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def min_score_hits(spark, sf_dir):
    vectors = N.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    found = Q.top_k(vectors, N.centroid_queries(spark, sf_dir, 4), L.DEFAULT_RECALL_K)
    return longs(Q.at_least_score(found, 0.45).select("case_id", "query_pos", "chunk_id", "rank"))


def rounded_report(report):
    return longs(report.select("case_id", "query_pos", "returned", *[
        stable_round(c, 6).alias(c) for c in ("top1", "mean", "lowest", "head_gap")],
        "distinct_sources", "low_confidence"))


@query
def retrieval_report(spark, sf_dir):
    return rounded_report(search_result(spark, sf_dir).reports)


@query
def gated_retrieval(spark, sf_dir):
    return longs(search_result(spark, sf_dir).kept.select(
        "case_id", "query_pos", "chunk_id", "rank", "rerank_rank",
        stable_round("score", 6).alias("score"), stable_round("rerank_score", 6).alias("rerank")))


@query
def merged_retrieval(spark, sf_dir):
    return longs(search_result(spark, sf_dir).merged.select(
        "case_id", "chunk_id", "position", "hit_by",
        stable_round("rerank_score", 6).alias("rerank")))


@query
def two_round_retrieval(spark, sf_dir):
    merged = search.merge_rounds(search_result(spark, sf_dir), search_result(spark, sf_dir, 3))
    return longs(merged.select("case_id", "chunk_id", "position", "hit_by", "round",
                               stable_round("rerank_score", 6).alias("rerank")))


@query
def retrieval_rules(spark, sf_dir):
    found = search_result(spark, sf_dir)
    cases = found.queries.select("case_id").distinct()
    return longs(Q.sufficiency_rules(cases, found.merged, found.reports).select(
        "case_id", "docs", "total", "refused", "rules"))


@query
def retrieval_summary(spark, sf_dir):
    found = search_result(spark, sf_dir)
    return longs(Q.retrieval_summary(found.queries, found.merged, found.reports, found.rerank_reports).select(
        "case_id", "docs", "sources", stable_round("gap_before", 6).alias("gap_before"),
        stable_round("gap_after", 6).alias("gap_after")))


@query
def context_budget(spark, sf_dir):
    blocks = Q.context_blocks(search_result(spark, sf_dir).merged, "rerank_score", True)
    return longs(blocks.select("case_id", "position", "chunk_id",
                               F.length("block").alias("block_chars"), "shown"))


@query
def context_text(spark, sf_dir):
    found = search_result(spark, sf_dir)
    blocks = Q.context_blocks(found.merged, "rerank_score", True)
    return longs(Q.context_text(found.queries, blocks).select(
        "case_id", "hits", "left_out", F.md5("context").alias("context_md5")))


@query
def retrieval_text(spark, sf_dir):
    """The text a reader gets per case: head lines, reports and context."""
    found = search_result(spark, sf_dir)
    blocks = Q.context_blocks(found.merged, "rerank_score", True)
    summary = Q.retrieval_summary(found.queries, found.merged, found.reports, found.rerank_reports)
    text = Q.result_text(found.reports, summary, Q.context_text(found.queries, blocks))
    return text.select("case_id", F.length("text").cast("long").alias("chars"),
                       F.md5("text").alias("text_md5"))


@query
def refusals(spark, sf_dir):
    return longs(Q.refusal_text(search_result(spark, sf_dir).reports))


@query
def query_cleanup(spark, sf_dir):
    """User turns as proposed sub-queries; the first user turn is the original question.

    Other turns are answers and are not proposals, so they are not read.
    """
    turns = N.table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("query_pos"),
        F.col("text").alias("query_text"))
    original = turns.groupBy("case_id").agg(
        F.min_by("query_text", "query_pos").alias("query_text"))
    cleaned = Q.clean_queries(turns, original, L.DEFAULT_SUB_QUESTIONS)
    return longs(Q.with_fallback(original, cleaned).select(
        "case_id", "n", F.md5("query_text").alias("query_md5"), "degraded"))


# ---- documents ---------------------------------------------------------------------------------

def pages_of(spark, sf_dir):
    return N.manual_pages(N.table(spark, sf_dir, "documents"))


@query
def text_normalise(spark, sf_dir):
    documents = N.table(spark, sf_dir, "documents")
    spaced = F.concat(F.lit("\ufeff"), F.replace("text", F.lit(", "), F.lit(" \\_ \t ")), F.lit(" \n\n\n\n x "))
    clean = documents.select("doc_id", TX.normalise(spaced).alias("text"))
    return longs(clean.select("doc_id", F.length("text").alias("chars"),
                              F.md5("text").alias("text_md5")))


@query
def repeated_lines(spark, sf_dir):
    pages = N.table(spark, sf_dir, "documents").select(
        F.lit("pdf").alias("file_type"), TX.fold_space(F.col("text")).alias("text"))
    total = pages.agg(F.count(F.lit(1))).scalar()
    counts = P.edge_line_counts(pages).withColumn("n_pages", total)
    return longs(counts.select(
        F.md5("line").alias("line_md5"), "pages", "n_pages",
        ((F.col("pages") >= L.HEADER_MIN_RATIO * F.col("n_pages"))
         & (F.length("line") <= L.HEADER_MAX_LEN)).alias("is_header")))


@query
def text_quality(spark, sf_dir):
    documents = N.table(spark, sf_dir, "documents")
    rows = documents.withColumns(TX.quality_features("text"))
    return longs(rows.withColumn("credible", TX.credible()).select(
        "doc_id", "chars", "digits", "units", "tags", "keys", "credible"))


@query
def heading_paths(spark, sf_dir):
    return longs(P.heading_paths(P.outline(pages_of(spark, sf_dir))).select(
        "source", "part", "heading_no", "level", "title", "depth",
        F.array_join("path", " > ").alias("path")))


@query
def table_runs(spark, sf_dir):
    lines = P.classify_lines(pages_of(spark, sf_dir))
    return longs(lines.groupBy("source", "part", "type").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("block").alias("blocks"),
        F.sum(F.col("heading").cast("int")).alias("headings")))


@query
def doc_blocks(spark, sf_dir):
    return longs(P.records(pages_of(spark, sf_dir)).select(
        "doc_id", "source", "part", "ordinal", "content_type", "char_count",
        F.array_join("section_path", " > ").alias("section_path"),
        F.md5("raw_text").alias("text_md5")))


@query
def chunks(spark, sf_dir):
    _, _, pieces = knowledge.build(pages_of(spark, sf_dir))
    return longs(chunking.flat_metadata(pieces))


@query
def chunk_upsert(spark, sf_dir):
    """A second build of the same pages leaves the number of chunks unchanged."""
    _, records, pieces = knowledge.build(pages_of(spark, sf_dir))
    table = chunking.upsert(pieces, chunking.chunks(records))
    return longs(table.groupBy("source", "content_type").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("chars")))


@query
def csv_segments(spark, sf_dir):
    rows = N.csv_rows(N.load_telemetry(spark, sf_dir))
    return longs(DS.csv_pages(rows).select("source", "part", "segment_value", "row_count",
                                           F.md5("text").alias("text_md5")))


@query
def sheet_text(spark, sf_dir):
    """Order lines as sheet rows: one sheet per order."""
    items = N.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source"), F.lit(0).alias("sheet_no"),
        F.lit("lines").alias("sheet_name"),
        F.format_string("%d/%d", "l_linenumber", "l_partkey").alias("row_no"),
        F.array(F.concat(F.lit(" "), F.col("l_partkey").cast("string")), F.col("l_returnflag"),
                F.when(F.col("l_linestatus") == "F", F.lit("")).otherwise(F.col("l_linestatus")))
        .alias("cells"))
    return longs(DS.sheet_pages(items).select("source", F.md5("text").alias("text_md5"),
                                              F.length("text").alias("chars")))


@query
def user_value_cv(spark, sf_dir):
    """Rolling variation of the event values of each user, over the user's whole history.

    Users have a few events per day, so almost every window reaches across several slices.
    """
    events = N.table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("ON").alias("state"),
        F.col("value").alias("flow_rate"), (F.col("value") + 100).alias("press_out"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e12 + F.col("value") / 500).alias("temp_de"),
        *[F.lit(1.0).alias(c) for c in ("press_in", "temp_nde", "vib_rms_de", "vib_rms_nde",
                                        "motor_current")])
    series = U.Series(keys=("user_id",), ts="ts", state="state", slice_seconds=86400, block=8)
    seg = S.segment_metrics(S.telemetry_runs(events, series), series)
    return longs(seg.select("user_id", "seg_index", "data_points", "avg_flow", "cv_flow",
                            "cv_flow_peak", "cv_press_peak"))


# ---- readers, small functions ------------------------------------------------------------------

@query
def device_history(spark, sf_dir):
    """Every frame of the device that holds a third of all rows."""
    return longs(TS.history(N.load_telemetry(spark, sf_dir), "PUMP-IS100-00000"))


@query
def device_window(spark, sf_dir):
    return longs(TS.window(N.load_telemetry(spark, sf_dir), "PUMP-IS100-00000",
                           "2026-09-13T00:05:00Z", "2026-09-13T04:05:00"))


@query
def plain_numbers(spark, sf_dir):
    """Quotients that are no number become null."""
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(
        F.col("l_extendedprice") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return longs(N.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", plain_number(ratio.cast("double"), 3)
        .alias("price_per_discount")))


@query
def image_uris(spark, sf_dir):
    """Documents behind the leading bytes of five formats, one of them not supported."""
    heads = ["FFD8FF00", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "424D"]
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in heads]),
                        (F.col("doc_id") % 5 + 1).cast("int"))
    rows = N.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))
    typed = rows.withColumn("mime", image_type("content"))
    return longs(typed.select("doc_id", "mime", F.sha2("content", 256).alias("sha256"),
                              F.md5(data_url("content", "mime")).alias("url_md5")))


@query
def segment_views(spark, sf_dir):
    """Segments rebuilt from the long measurements."""
    runs, seg = shared_segments(spark, sf_dir)
    rows = M.measurements(seg, S.overall_metrics(runs, seg), ["device_id"])
    return longs(M.segment_views(seg, rows, ["device_id"]).select(
        "device_id", "seg_index", "state", *L.SEGMENT_UNITS))


@query
def l2_cosine(spark, sf_dir):
    """Cosine of each vector and the first of its group of seven, from their distance."""
    e = N.table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.expr("vec_id div 7") * 7).alias("first"), "embedding")
    pairs = e.join(e.select(F.col("vec_id").alias("first"), F.col("embedding").alias("other")), "first")
    squared = F.aggregate(F.zip_with("embedding", "other", lambda a, b: (
        a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))),
        F.lit(0.0), lambda s, v: s + v)
    return longs(pairs.withColumn("distance", squared).select(
        "vec_id", stable_round(Q.cosine_from_distance("distance"), 5).alias("cosine")))


@query
def unfinished_cases(spark, sf_dir):
    """Cases without a photo result yet."""
    cases, _, images = case_inputs(spark, sf_dir)
    return longs(C.not_yet_done(cases, images.select("trace_id").distinct()).select(
        "trace_id", "device_id"))


@query
def attached_images(spark, sf_dir):
    """Photo references of a case and their results by position; every other result is missing."""
    _, _, images = case_inputs(spark, sf_dir)
    listed = images.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "image_id", "description", "limitations", "observations"))).alias("found"))
    refs = V.image_refs(listed.select("trace_id", F.transform(
        "found", lambda x: F.struct(x["image_id"].alias("image_id"))).alias("image_refs")))
    results = listed.select("trace_id", F.posexplode("found").alias("pos", "f")).filter(
        F.col("pos") % 2 == 0).select("trace_id", "pos", "f.description", "f.limitations",
                                      "f.observations")
    return longs(V.attach_results(refs, results).select(
        "trace_id", "pos", "image_id", "description",
        F.array_join("limitations", "; ").alias("limitations")))


@query
def repeated_queries(spark, sf_dir):
    """Turns of a conversation as queries: repeated texts count once, at their first place."""
    turns = N.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("query_pos"),
        F.col("text").alias("query_text"), F.lit(0).alias("query_vec"))
    return longs(Q.distinct_queries(turns).select(
        "case_id", F.md5("query_text").alias("query_md5"), "query_pos"))


@query
def retry_cases(spark, sf_dir):
    """Reviews of conversations: worth another round or not, and the note for the reader."""
    key = F.col("case_id")
    some = lambda test, *x: F.when(test, F.array(*[F.lit(v) for v in x])).otherwise(
        F.array().cast("array<string>"))
    rows = N.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(
        F.count(F.lit(1)).alias("turns")).withColumns({
            "consulted": key % 5 != 0, "error": F.when(key % 7 == 0, "x").otherwise(""),
            "sufficient": key % 3 == 0, "next_queries": some(F.col("turns") > 2, "q"),
            "missing": some(F.col("turns") > 3, "a", "b")})
    return longs(rows.select("case_id", Q.retry_worthy().alias("retry"), Q.review_note().alias("note")))


@query
def build_report(spark, sf_dir):
    pages, records, pieces = knowledge.build(pages_of(spark, sf_dir))
    files = N.table(spark, sf_dir, "documents").select("source").distinct().count()
    return longs(DS.build_report(files, pages, records, pieces))
