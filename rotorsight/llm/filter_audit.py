"""What each filter of a chain removes, in every order of the chain.

Failures are ids: a scan gives those of the four text filters; the fifth, "an earlier document has
this text", is an existential self-join: a document fails if one with the same hash, the same text
and a smaller id exists (left-semi join). Only the smallest id of a text can be needed as the
witness, so the inner side holds one row per different text. The union of all failure ids, grouped
by id, gives one bit combination per document; counts per part and combination (at most 32 per
part) are all that the 120 orders need.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, id_text, text_hash

#: The filters, their order in a combination (bit i is the i-th letter), thresholds.
FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COPY = 1 << FILTERS.index("E")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text only (A to D); null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, "[\\x20\\x09-\\x0D]+", -1), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n_words < MIN_WORDS,
        "B": 100 * n_distinct < MIN_DISTINCT_PERCENT * n_words,
        "C": 100 * F.regexp_count(body, F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length(body),
        "D": body.rlike(SYMBOLS),
    }
    return sum((F.when(failed, _bit(f)).otherwise(0) for f, failed in fails.items()), F.lit(0))


def later_copies(texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (doc_id, h, text, ...) whose text a row with a smaller doc_id has, too.

    Only rows whose hash repeats are compared. Rows without an id neither fail nor are witnesses.
    """
    repeated = cut(texts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    # Files on both sides of each join: Spark can then split a text that very many rows share.
    rows = cut(texts.join(repeated, "h", "left_semi"))
    firsts = cut(rows.groupBy("h", "text").agg(F.min("doc_id").alias("first_id")))
    mine, first = rows.alias("mine"), firsts.alias("first")
    return mine.join(first, F.expr("mine.h = first.h and mine.text = first.text "
                                   "and first.first_id < mine.doc_id"), "left_semi")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (value of lang; null: empty) and failure bits: part, mask, n, good, toxic.

    ``good`` and ``toxic`` count documents that some row of ``labels`` marks with quality 1 and
    toxic 1; repeated labels count once, labels without an id never.
    """
    rows = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("h"),
                       F.coalesce("lang", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    key = ["k1", "h", "part"]
    copies = later_copies(rows.select("doc_id", *key, "text"))
    failed = rows.select(*key, text_failures(F.col("text")).alias("bits"), F.lit(1).alias("n")).union(
        copies.select(*key, F.lit(COPY), F.lit(0)))
    # Rows that agree in id, text and part fail alike; n says how many they are.
    masks = failed.groupBy(*key).agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(id_text().alias("k1")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return masks.join(marks, "k1", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there.

    Columns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley; counts are of rows of ``docs`` inside the part. Null texts count as empty
    (and are copies of each other), a null lang is the part of the empty string. Rows that repeat
    as a whole are documents of their own, neither smaller than the other. Texts of any length are
    split as a whole in one row. An empty ``docs`` gives no rows, empty ``labels`` zeros; other
    columns are not read.
    """
    counts = combinations(docs, labels)
    steps = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn(
        "step", F.explode(F.array(*(F.lit(i + 1) for i in range(len(FILTERS))))))
    before = F.expr("substring(filter_order, 1, step - 1)")
    now = F.expr("substring(filter_order, step, 1)")
    earlier = sum((F.when(before.contains(f), _bit(f)).otherwise(0) for f in FILTERS), F.lit(0))
    own = sum((F.when(now == f, _bit(f)).otherwise(0) for f in FILTERS), F.lit(0))
    steps = steps.withColumn("own", own).withColumn("earlier", earlier)
    fails, gone = F.expr("(mask & own) <> 0"), F.expr("(mask & earlier) <> 0")
    first = fails & ~gone
    # Of the failures of a document each comes first in an equal share of all orders.
    share = F.expr(f"n * ({len(ORDERS)} div bit_count(mask))")
    total = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(first).alias("removed"),
        total(fails & gone).alias("redundant"), total(F.expr("mask = own")).alias("unique_fails"),
        total(first, "good").alias("good_lost"), total(first, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"))
