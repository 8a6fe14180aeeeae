"""Vector retrieval over supplied embeddings: exact top-k, gate, rerank, merge, text.

Queries are rows (case_id, query_pos, query_text, query_vec), chunks (chunk_id, embedding, source,
...). Vectors are unit length, so the dot product is the cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import limits as L
from ..functions.scalars import query_key, stable_round, strip, tail_name

QUERY_BLOCK_BYTES = 32 << 20        # query vectors that are sent to the tasks at once
SCORE_DIGITS = 9                    # scores are compared at this precision, ties go to the id


def checked_k(k: int | None, default: int = L.DEFAULT_TOP_K) -> int:
    """The number of results asked for; outside 1 to 20 is an error, never a silent cut."""
    k = int(default if k is None else k)
    if not 1 <= k <= L.MAX_TOP_K:
        raise ValueError(f"k is {k}; it must be between 1 and {L.MAX_TOP_K}")
    return k


def checked_recall(recall_k: int | None, k: int, reranking: bool) -> int:
    """Candidates per query; by default 15, or just ``k`` when nothing reranks.

    Fewer than ``k`` or more than 50 is an error, never a silent change.
    """
    if recall_k is None:
        recall_k = max(k, L.DEFAULT_RECALL_K) if reranking else k
    if not k <= int(recall_k) <= L.MAX_RECALL_K:
        raise ValueError(f"recall_k is {recall_k}; it must be between {k} and {L.MAX_RECALL_K}")
    return int(recall_k)


def cosine(a, b) -> Column:
    """Cosine of two unit vectors, clamped."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0),
                      lambda s, v: s + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def cosine_from_distance(distance) -> Column:
    """Squared Euclidean distance of unit vectors to cosine."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col(distance) / 2))


def distinct_queries(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Blank and repeated query texts removed (first position kept).

    With ``limit``, at most so many per case; ``dropped_queries`` tells which were left out.
    """
    text = strip(F.coalesce("query_text", F.lit("")))
    first = (queries.withColumn("query_text", text).filter(F.col("query_text") != "")
             .groupBy("case_id", "query_text")
             .agg(F.min("query_pos").alias("query_pos"),
                  F.min_by("query_vec", "query_pos").alias("query_vec")))
    order = W.partitionBy("case_id").orderBy("query_pos")
    if limit is None:
        return first
    return first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def dropped_queries(queries: DataFrame, kept: DataFrame) -> DataFrame:
    """Queries beyond the cap, so that the caller knows what was not searched."""
    named = queries.withColumn("query_text", strip("query_text")).filter("query_text <> ''")
    named = named.groupBy("case_id", "query_text").agg(F.min("query_pos").alias("query_pos"))
    return named.join(kept.select("case_id", "query_text"), ["case_id", "query_text"], "left_anti")


def _best(ids, scores, k) -> pd.DataFrame:
    """The ``k`` best by rounded score, then id; ties at the cut are resolved exactly."""
    scores = np.round(scores, SCORE_DIGITS)
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    table = pd.DataFrame({"chunk_id": ids, "score": scores})
    return table.sort_values(["score", "chunk_id"], ascending=[False, True]).head(k)


def _block_top_k(query_nos, matrix, ids, vectors, k) -> pd.DataFrame:
    scores = np.clip(np.asarray(vectors, dtype=np.float64) @ matrix.T, -1.0, 1.0)
    parts = [_best(ids, scores[:, i], k).assign(query_no=no) for i, no in enumerate(query_nos)]
    return pd.concat(parts) if parts else pd.DataFrame(columns=["chunk_id", "score", "query_no"])


def _query_blocks(queries: DataFrame, block_bytes: int):
    """(case_id, query_pos) pairs and vectors, in blocks of bounded size."""
    keys, vectors, size = [], [], 0
    for case_id, pos, vector in queries.select("case_id", "query_pos", "query_vec").toLocalIterator():
        keys.append((case_id, pos))
        vectors.append(vector)
        size += 8 * len(vector)
        if size >= block_bytes:
            yield keys, np.array(vectors, dtype=np.float64)
            keys, vectors, size = [], [], 0
    if keys:
        yield keys, np.array(vectors, dtype=np.float64)


def top_k(chunks: DataFrame, queries: DataFrame, k: int, id_type: str = "long",
          block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Exact best ``k`` chunks per query: (query columns, chunk_id, score, rank from 0).

    The queries are taken in blocks of bounded size, each against all chunks, which are never
    moved: scores are a matrix product inside the tasks, and a task keeps only its best ``k`` per
    query, so ``queries x k`` rows per task are shuffled instead of all pairs.
    """
    vectors = chunks.select("chunk_id", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = f"case_id {kinds['case_id']}, query_pos {kinds['query_pos']}, chunk_id {id_type}, score double"

    def scan_for(keys, matrix):
        shared = chunks.sparkSession.sparkContext.broadcast((keys, matrix))

        def scan(batches):
            keys, matrix = shared.value
            best = None
            for batch in batches:
                if not len(batch):
                    continue
                found = _block_top_k(range(len(keys)), matrix, batch["chunk_id"].to_numpy(),
                                     np.stack(batch["embedding"].to_numpy()), k)
                best = found if best is None else pd.concat([best, found]) \
                    .sort_values(["score", "chunk_id"], ascending=[False, True]) \
                    .groupby("query_no", sort=False).head(k)
            if best is not None:
                best["case_id"] = [keys[n][0] for n in best["query_no"]]
                best["query_pos"] = [keys[n][1] for n in best["query_no"]]
                yield best[["case_id", "query_pos", "chunk_id", "score"]]
        return vectors.mapInPandas(scan, schema)

    partial = None
    for keys, matrix in _query_blocks(queries, block_bytes):
        found = scan_for(keys, matrix)
        partial = found if partial is None else partial.union(found)
    if partial is None:
        partial = chunks.sparkSession.createDataFrame([], schema)
    order = W.partitionBy("case_id", "query_pos").orderBy(F.desc("score"), "chunk_id")
    ranked = partial.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
    return ranked.join(queries.drop("query_vec"), ["case_id", "query_pos"])


def at_least_score(hits: DataFrame, least: float) -> DataFrame:
    """Drop weak hits after ranking, so ranks keep their gaps."""
    return hits.filter(F.col("score") >= least)


def reports(hits: DataFrame, queries: DataFrame, score: str = "score", rank: str = "rank",
            gate: float = L.SCORE_GATE) -> DataFrame:
    """Quality of each query's result; a query without hits reports zeros, not low confidence."""
    keys = ["case_id", "query_pos", "query_text"]
    found = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("returned"), F.max(score).alias("top1"), F.avg(score).alias("mean"),
        F.min(score).alias("lowest"), F.max(F.when(F.col(rank) == 1, F.col(score))).alias("second"),
        F.countDistinct("source").alias("distinct_sources"))
    filled = queries.select(*keys).join(found, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return filled.select(
        *keys, zero("returned"), zero("top1"), zero("mean"), zero("lowest"),
        F.coalesce(F.col("top1") - F.col("second"), F.lit(0.0)).alias("head_gap"),
        zero("distinct_sources"),
        F.coalesce(F.col("top1") < gate, F.lit(False)).alias("low_confidence"))


def term_overlap(query, text) -> Column:
    """Default pair score: share of the query's distinct words that occur in the text."""
    words = lambda c: F.array_distinct(F.split(F.lower(strip(c)), r"\s+"))
    return F.size(F.array_intersect(words(query), words(text))) / F.size(words(query))


def rerank(hits: DataFrame, score: Column, keep: int | None) -> DataFrame:
    """Second score per (query, chunk) pair; stable order, first ``keep`` per query.

    ``score`` is any column: an expression, a pandas UDF or a column supplied with the hits.
    """
    scored = hits.withColumn("rerank_score", stable_round(score, SCORE_DIGITS))
    order = W.partitionBy("case_id", "query_pos").orderBy(F.desc("rerank_score"), "rank")
    placed = scored.withColumn("rerank_rank", F.row_number().over(order) - 1)
    return placed if keep is None else placed.filter(F.col("rerank_rank") < keep)


def gate(hits: DataFrame, report: DataFrame) -> DataFrame:
    """Hits of the queries that were not refused; the gate always looks at the cosine."""
    passed = report.filter(~F.col("low_confidence")).select("case_id", "query_pos")
    return hits.join(passed, ["case_id", "query_pos"], "left_semi")


def merge_hits(hits: DataFrame, score: str) -> DataFrame:
    """One row per case and chunk: the best score and the query that won (ties: the earliest).

    ``round`` is honoured when present, so the union of two rounds merges by the same rule. Hits
    without a chunk id are told apart by where they stand and by their text.
    """
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "source", "section_path", "page", "sheet_name", "text") if c in hits.columns]
    identity = F.coalesce(F.concat(F.lit("id:"), F.col("chunk_id").cast("string")),
                          F.md5(F.concat_ws("\x1f", *place)))
    when = ["round"] if "round" in hits.columns else []
    first = F.struct(F.col(score), *[-F.col(c) for c in when], -F.col("query_pos"))
    kept = [c for c in hits.columns if c != "case_id"]
    best = hits.groupBy("case_id", identity.alias("identity")).agg(
        F.max_by(F.struct(*kept), first).alias("h")).select("case_id", "h.*")
    order = W.partitionBy("case_id").orderBy(F.desc(score), "chunk_id")
    return best.withColumnRenamed("query_text", "hit_by") \
        .withColumn("position", F.row_number().over(order))


def sufficiency_rules(cases: DataFrame, merged: DataFrame, report: DataFrame) -> DataFrame:
    """Rules that fired per case: empty, all_refused or majority_refused, grey_zone."""
    docs = merged.groupBy("case_id").agg(F.count(F.lit(1)).alias("docs"),
                                         F.max("score").alias("top1"))
    asked = report.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("low_confidence").cast("int")).alias("refused"))
    joined = cases.select("case_id").join(docs, "case_id", "left").join(asked, "case_id", "left") \
        .fillna(0, ["docs", "total", "refused"])
    total, refused = F.col("total"), F.col("refused")
    share = refused / F.nullif(total, F.lit(0))
    rules = F.array_compact(F.array(
        F.when(F.col("docs") == 0, "empty"),
        F.when((total > 0) & (refused >= total), "all_refused")
         .when((total >= 2) & (share >= L.MAJORITY_REFUSED), "majority_refused"),
        F.when((F.col("docs") > 0) & (F.col("top1") >= L.SCORE_GATE)
               & (F.col("top1") < L.GREY_ZONE_HIGH), "grey_zone")))
    return joined.withColumn("rules", rules)


def retrieval_summary(cases: DataFrame, merged: DataFrame, before: DataFrame,
                      after: DataFrame) -> DataFrame:
    """Per case: documents, distinct sources, mean head gap before and after reranking.

    A case without hits has no documents and no gaps.
    """
    docs = merged.groupBy("case_id").agg(F.count(F.lit(1)).alias("docs"),
                                         F.countDistinct(tail_name("source")).alias("sources"))
    gaps = (before.filter("returned > 0").select("case_id", "query_text", "head_gap").join(
        after.select("case_id", "query_text", F.col("head_gap").alias("gap_after")),
        ["case_id", "query_text"]).groupBy("case_id")
        .agg(F.avg("head_gap").alias("gap_before"), F.avg("gap_after").alias("gap_after")))
    return cases.select("case_id").distinct().join(docs, "case_id", "left").join(
        gaps, "case_id", "left").fillna(0, ["docs", "sources"])


def source_line() -> Column:
    """File name, section path, page and sheet of a hit, as far as known."""
    return F.concat_ws(
        " | ", F.coalesce(F.nullif(tail_name(F.coalesce("source", F.lit(""))), F.lit("")),
                          F.lit("未知来源")),
        F.nullif("section_path", F.lit("")),
        F.concat(F.lit("page="), F.col("page").cast("string")),
        F.concat(F.lit("sheet="), F.nullif("sheet_name", F.lit(""))))


def context_blocks(merged: DataFrame, score: str, reranked: bool,
                   block_chars: int = L.MAX_BLOCK_CHARS,
                   total_chars: int = L.MAX_TOTAL_CHARS) -> DataFrame:
    """Text block per merged hit and whether it fits the context budget of its case.

    A block shows ``block_chars`` characters of its text and a mark where it goes on; blocks are
    shown while they stay within ``total_chars`` per case. Both are budgets of the reader.
    """
    label = "重排分" if reranked else "相似度"
    text = F.when(F.length("text") > block_chars, F.concat(
        F.substring("text", 1, block_chars), F.lit(L.TRUNCATED_MARK))) \
        .otherwise(F.col("text"))
    block = F.concat(F.format_string(f"\n[%d] {label} %.3f｜", "position", score), source_line(),
                     F.lit("\n    命中查询："), F.coalesce("hit_by", F.lit("")), F.lit("\n"), text)
    order = W.partitionBy("case_id").orderBy("position")
    used = F.sum(F.length("block")).over(order)
    return merged.withColumn("block", block).withColumn("used", used) \
        .withColumn("shown", F.col("used") <= total_chars)


def context_text(cases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text per case: shown blocks in order, then how many did not fit; empty without hits."""
    listed = F.transform(F.array_sort(F.collect_list(
        F.when(F.col("shown"), F.struct("position", "block")))), lambda b: b["block"])
    left = F.sum((~F.col("shown")).cast("int"))
    note = F.when(left > 0, F.format_string("\n（其余 %d 条超出上下文预算，未展示）", left))
    texts = blocks.groupBy("case_id").agg(
        F.concat_ws("\n", F.array_join(listed, "\n"), note).alias("context"),
        F.count(F.lit(1)).alias("hits"), left.alias("left_out"))
    return cases.select("case_id").distinct().join(texts, "case_id", "left").fillna(
        "", ["context"]).fillna(0, ["hits", "left_out"])


def result_text(reports: DataFrame, summary: DataFrame, contexts: DataFrame,
                reranked: bool = True) -> DataFrame:
    """Whole text per case: counts, a line per query with its report, then the context.

    ``summary`` comes from ``retrieval_summary``, ``contexts`` from ``context_text``; both have a
    row per case. Running times are left out: a case has none of its own in a shared job.
    """
    mark = F.when(F.col("low_confidence"), "✗ 低置信拒答").otherwise("✓")
    number = lambda c: F.format_string("%.3f", stable_round(c, SCORE_DIGITS).cast("double"))
    line = F.concat(
        F.lit("  "), mark, F.lit(" "), F.col("returned").cast("string"),
        F.lit(" 条 | retrieval_score top1="), number("top1"), F.lit(" 均值="), number("mean"),
        F.lit(" 最低="), number("lowest"), F.lit(" 头距="), number("head_gap"), F.lit(" | 来源 "),
        F.col("distinct_sources").cast("string"), F.lit(" 个"),
        F.when(F.col("low_confidence"), "  ⚠️ 低置信").otherwise(""), F.lit("｜"), "query_text")
    asked = reports.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("low_confidence").alias("refused"),
        F.array_sort(F.collect_list(F.struct("query_pos", line.alias("line")))).alias("lines"))
    gaps = lambda arrow: F.concat(number("gap_before"), F.lit(arrow), number("gap_after"))
    has_gap = F.col("gap_before").isNotNull() & F.lit(reranked)
    head = F.concat(
        F.lit("知识库检索结果｜共 "), F.col("queries").cast("string"), F.lit(" 条查询｜"),
        F.col("queries").cast("string"), F.lit(" 条 query -> 去重后 "), F.col("docs").cast("string"),
        F.lit(" 条片段 | 来源 "), F.col("sources").cast("string"), F.lit(" 个 | 低置信 "),
        F.col("refused").cast("string"), F.lit(" 条 | " + ("重排" if reranked else "向量")),
        F.when(has_gap, F.concat(F.lit(" | head_gap "), gaps("→"))).otherwise(""))
    refused = F.when(F.col("refused") > 0, F.concat(
        F.lit("（上述 "), F.col("refused").cast("string"),
        F.lit(" 条查询知识库中无相关内容，按约定未返回其片段）")))
    stage = F.when(has_gap, F.concat(F.lit("  （重排收敛：head_gap 均值 "), gaps(" → "), F.lit("）")))
    if reranked:
        stage = stage.otherwise(
            "  （已启用重排：片段按重排分排序，下方分数为**重排分**，与相似度不可比）")
    body = F.when(F.col("hits") == 0, "\n请如实告知用户知识库中没有相关资料，并可以建议用户换个说法或"
                  "补充背景信息；不要凭已有知识作答。").otherwise(F.col("context"))
    rows = asked.join(summary, "case_id").join(contexts, "case_id")
    return rows.select("case_id", F.concat_ws(
        "\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), refused, stage,
        body).alias("text"))


def refusal_text(report: DataFrame) -> DataFrame:
    """Message for refused queries and for queries without any hit."""
    refused = F.concat(
        F.lit("知识库中没有找到与问题相关的内容。\n查询："), "query_text",
        F.format_string("\n检索到的最高相似度 %.3f，低于置信度阈值 ", "top1"),
        F.lit(f"{L.SCORE_GATE}——按约定此时不提供片段，以免基于不相关内容编造答案。\n"
              "请如实告知用户知识库中没有相关资料，并可以建议用户换个说法或补充背景信息；"
              "不要凭已有知识作答。"))
    empty = F.concat(F.lit("知识库中没有检索到相关内容。\n查询："), "query_text",
                     F.lit("\n请如实告知用户知识库中没有相关资料，不要凭已有知识编造答案。"))
    return report.filter(F.col("low_confidence") | (F.col("returned") == 0)).select(
        "case_id", "query_pos", F.when(F.col("low_confidence"), refused).otherwise(empty)
        .alias("message"))


# ---- query clean-up --------------------------------------------------------------------------------

def clean_queries(proposed: DataFrame, exclude: DataFrame, limit: int) -> DataFrame:
    """Proposed queries per case without blanks, repeats and those equal to an excluded text.

    Texts are compared by their key (no white space, no closing punctuation). Repeats are removed
    by partial aggregation before any ordering, and the row-number filter is applied as a group
    limit before the shuffle, so a case with very many proposals stays cheap.
    """
    keyed = proposed.withColumn("query_text", strip(F.coalesce("query_text", F.lit("")))) \
        .filter(F.col("query_text") != "").withColumn("key", query_key("query_text"))
    first = keyed.groupBy("case_id", "key").agg(
        F.min("query_pos").alias("query_pos"),
        F.min_by("query_text", "query_pos").alias("query_text"))
    known = exclude.select("case_id", query_key("query_text").alias("key")).distinct()
    order = W.partitionBy("case_id").orderBy("query_pos")
    return (first.join(known, ["case_id", "key"], "left_anti")
            .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit))


def with_fallback(originals: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Cleaned queries, or the original one marked degraded where none is left."""
    joined = originals.select("case_id", F.col("query_text").alias("original")).join(
        cleaned.select("case_id", "n", "query_text"), "case_id", "left")
    return joined.select("case_id", F.coalesce("n", F.lit(1)).alias("n"),
                         F.coalesce("query_text", "original").alias("query_text"),
                         F.col("query_text").isNull().alias("degraded"))


def retry_worthy() -> Column:
    """Reviewed without error, judged insufficient, and with something new to ask."""
    reviewed = F.col("consulted") & (F.coalesce("error", F.lit("")) == "")
    return reviewed & ~F.col("sufficient") & (F.size("next_queries") > 0)


def review_note() -> Column:
    """Note about the review that goes with the context; blank when there is nothing to say."""
    missing = F.when(F.size("missing") > 0, F.array_join("missing", "；")).otherwise("部分信息")
    return (F.when(~F.col("consulted"), "")
            .when(F.coalesce("error", F.lit("")) != "",
                  "\n\n⚠️ 说明：本次检索结果**未经审阅**（审阅环节不可用），覆盖可能不完整。"
                  "若片段不足以回答，请如实告知用户，不要凭已有知识补充。")
            .when(F.col("sufficient"), "").otherwise(F.concat(
                F.lit("\n\n⚠️ 审阅结论：上述片段**不足以完整回答**该问题，缺少："), missing,
                F.lit("。已尝试补查但仍未覆盖。请**如实告知用户哪部分知识库中没有**，"
                      "不要把现有片段当成完整资料作答，更不要凭已有知识补齐。"))))
