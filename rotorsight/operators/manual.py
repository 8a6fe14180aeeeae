"""Manual passages for a case: the built-in topics and keyword matching of a clause table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import limits as L
from ..functions.scalars import evidence_ref, text_array
from .terms import found_terms

TOP_CLAUSES = 5


def _topic_applies(topic: str) -> Column:
    """Does a built-in topic apply to the case row (flags, alarm_code, user_query, findings)?"""
    alarm = F.upper(F.coalesce("alarm_code", F.lit("")))
    query = F.lower(F.coalesce("user_query", F.lit("")))
    tests = []
    if topic in L.TOPIC_FLAGS:
        tests.append(F.arrays_overlap("flags", text_array(L.TOPIC_FLAGS[topic])))
    if topic in L.TOPIC_ALARM:
        tests.append(F.contains(alarm, F.lit(L.TOPIC_ALARM[topic])))
    tests += [F.contains(query, F.lit(word)) for word in L.TOPIC_WORDS.get(topic, [])]
    if topic in L.TOPIC_DEFECT:
        tests.append(F.exists("findings", lambda f: F.upper(f["defect_type"])
                              == L.TOPIC_DEFECT[topic]))
    combined = tests[0]
    for test in tests[1:]:
        combined = combined | test
    return F.coalesce(combined, F.lit(False))


def builtin_topics(cases: DataFrame) -> DataFrame:
    """Add ``manual_status``, ``evidences``, ``requirements``, ``actions`` and ``mechanism``.

    The topics are five constant rows, so they are filtered inside the case row: no join.
    """
    fields = ["topic", "chunk_id", "section", "page", "score", "channel", "quote", "requirement",
              "action", "priority", "mechanism"]
    fallback = L.MANUAL_TOPICS[-1][0]
    hit = {t[0]: F.col(f"_{t[0]}") for t in L.MANUAL_TOPICS if t[0] != fallback}
    flagged = cases.withColumns({f"_{t}": _topic_applies(t) for t in hit})
    none = None
    for flag in hit.values():
        none = ~flag if none is None else none & ~flag
    rows = F.array_compact(F.array(*[
        F.when(hit.get(t[0], none), F.struct(
            *[F.lit(v).cast("int" if n == "page" else "double" if n == "score" else "string")
              .alias(n) for n, v in zip(fields, t)], F.lit(L.MANUAL_DOC).alias("doc_id")))
        for t in L.MANUAL_TOPICS]))
    ref = lambda t: evidence_ref(
        "MANUAL", F.concat(t["doc_id"], F.lit("#"), t["chunk_id"]),
        F.concat(F.lit("page "), t["page"].cast("string"), F.lit(" · "), t["section"]))
    topics = F.col("topics")
    return (flagged.withColumn("topics", rows).withColumns({
        "manual_status": F.lit("HIT"),
        "evidences": F.transform(topics, lambda t: F.struct(
            t["doc_id"].alias("doc_id"), t["chunk_id"].alias("chunk_id"),
            t["section"].alias("section"), t["page"].alias("page"), t["quote"].alias("quote"),
            t["score"].alias("score"), t["channel"].alias("channel"))),
        "requirements": F.transform(
            F.filter(topics, lambda t: t["requirement"].isNotNull()),
            lambda t: F.struct(t["requirement"].alias("requirement"), ref(t).alias("source_ref"))),
        "actions": F.transform(topics, lambda t: F.struct(
            t["action"].alias("action"), t["priority"].alias("priority"),
            ref(t).alias("source_ref"))),
        "mechanism": F.array_join(F.transform(topics, lambda t: t["mechanism"]), "；")})
        .drop("topics", *[f"_{t}" for t in hit]))


def clause_scores(cases: DataFrame, clauses: DataFrame) -> DataFrame:
    """Score of every clause with at least one matching term: matched terms / terms.

    A term matches when it is one of the case's rule codes or occurs in its text. Rule codes are
    compared by an equi-join, texts by automata over all terms: what comes back are matches, so
    the join with the clauses meets nothing that does not count.
    """
    terms = clauses.select("doc_id", "chunk_id", F.posexplode(
        F.concat("rule_codes", "keywords")).alias("term_pos", "term"))
    sizes = clauses.select("doc_id", "chunk_id", F.size(F.concat("rule_codes", "keywords"))
                           .alias("n_terms"))
    usable = terms.filter(F.length("term") > 0)
    note = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("alarm_code", F.lit("")))
    found = found_terms(cases, "trace_id", note, usable.select("term")).union(
        cases.select("trace_id", F.explode("flags"))).join(usable, "term")
    hits = found.groupBy("trace_id", "doc_id", "chunk_id").agg(
        F.countDistinct("term_pos").alias("hits"))
    return hits.join(sizes, ["doc_id", "chunk_id"]).withColumn(
        "score", F.col("hits") / F.col("n_terms"))


def match_clauses(cases: DataFrame, clauses: DataFrame, top: int = TOP_CLAUSES) -> DataFrame:
    """Best clauses per case, ranked by score and then chunk id."""
    order = W.partitionBy("trace_id").orderBy(F.desc("score"), "chunk_id", "doc_id")
    ranked = clause_scores(cases, clauses).withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= top)
    return ranked.join(clauses, ["doc_id", "chunk_id"])


def clause_evidence(cases: DataFrame, clauses: DataFrame, manual_key: str = "manual") -> DataFrame:
    """Case rows with the clause-based manual columns; NO_HIT when nothing matched."""
    ref = evidence_ref("MANUAL", F.concat("doc_id", F.lit("#"), "chunk_id"),
                       F.concat(F.lit(manual_key), F.lit(" · "), "section"))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    rows = match_clauses(cases, clauses).withColumns({
        "e": F.struct("rank", "doc_id", "chunk_id", "section",
                      F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), "quote",
                      "score", F.lit("KEYWORD").alias("channel")),
        "r": F.when(filled("requirement"), F.struct("rank", "requirement",
                                                    ref.alias("source_ref"))),
        "a": F.when(filled("action"), F.struct("rank", "action", F.lit("HIGH").alias("priority"),
                                               ref.alias("source_ref"))),
        "m": F.when(filled("mechanism"), F.struct("rank", "mechanism"))})
    ordered = lambda c: F.array_sort(F.collect_list(c))
    # At most five rows per case from here on.
    found = rows.groupBy("trace_id").agg(
        ordered("e").alias("e"), ordered("r").alias("r"), ordered("a").alias("a"),
        ordered("m").alias("m")).select(
        "trace_id",
        F.transform("e", lambda x: F.struct(
            x["doc_id"].alias("doc_id"), x["chunk_id"].alias("chunk_id"),
            x["section"].alias("section"), x["page"].alias("page"), x["quote"].alias("quote"),
            x["score"].alias("score"), x["channel"].alias("channel"))).alias("evidences"),
        F.transform("r", lambda x: F.struct(x["requirement"].alias("requirement"),
                                            x["source_ref"].alias("source_ref")))
        .alias("requirements"),
        F.transform("a", lambda x: F.struct(x["action"].alias("action"),
                                            x["priority"].alias("priority"),
                                            x["source_ref"].alias("source_ref"))).alias("actions"),
        F.array_join(F.transform("m", lambda x: x["mechanism"]), "；").alias("mechanism"))
    joined = cases.join(found, "trace_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType))
    return joined.withColumns({
        "manual_status": F.when(F.col("evidences").isNull(), "NO_HIT").otherwise("HIT"),
        "evidences": empty("evidences"), "requirements": empty("requirements"),
        "actions": empty("actions"), "mechanism": F.coalesce("mechanism", F.lit(""))})
