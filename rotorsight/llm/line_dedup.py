"""Removal of lines that many sites share, by the spread of each line over distinct sites.

Per line hash a HyperLogLog sketch of its sites is merged by aggregation. Lines whose estimate
lies near the threshold get an exact count of distinct sites. Lines at or over the threshold are
boilerplate and leave every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text, text_hash

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10
#: Size of a sketch (2 ** LG_K registers) and its relative standard error.
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)
#: A character that is not white space.
VISIBLE = "[^\\x20\\x09-\\x0D]"
#: Estimates within so many standard errors of the threshold are counted exactly.
DEVIATIONS = 6


def lines(docs: DataFrame) -> DataFrame:
    """One row per line of one or more characters that are not white space: key, place, hashes."""
    # Keys first: beside the generator they would be computed once per line.
    keyed = docs.select(id_text().alias("k1"), text_hash().alias("k2"), "source", "text")
    parts = keyed.select("k1", "k2", "source",
                         F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1))
                         .alias("place", "line"))
    return parts.filter(F.col("line").rlike(VISIBLE)).select(
        "k1", "k2", "source", "place", F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (h1, h2) of lines on at least ``min_sites`` distinct sites, with the site count.

    ``rows`` has h1, h2 and source; a null source is no site. A line must first be seen on two
    sites (smallest and largest differ), which needs no sketch and drops most lines.
    """
    spread = rows.groupBy("h1", "h2").agg(F.min("source").alias("low"), F.max("source").alias("high"))
    seen = rows.filter("source is not null").select("h1", "h2", "source")
    if min_sites > 1:
        # Written first: Spark splits hot lines in a join of plain tables.
        wide = cut(spread.filter("low <> high").select("h1", "h2"))
        seen = seen.join(wide, ["h1", "h2"], "left_semi")
    seen = cut(seen)
    # Sketches are built where the lines are read and merged by the aggregation.
    sketched = seen.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LG_K))).alias("n_sites"))
    band = max(1.0, DEVIATIONS * ERROR * min_sites)
    near = F.abs(F.col("n_sites") - min_sites) <= band
    sketched = cut(sketched)
    exact = seen.join(cut(sketched.filter(near).select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy(
        "h1", "h2", "source").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(
        F.count("one").alias("n_sites"))
    return sketched.filter(~near).union(exact).filter(F.col("n_sites") >= min_sites)


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text (of the lines that stay).

    Lines are the parts between line feeds; those of white space only (also a lone carriage
    return) are never removed. The places of removed lines are gathered per document, so lines
    themselves are never shuffled; the work is linear in the lines of a document.
    Null texts count as empty; repeated rows have equal results. Other columns are not read.
    """
    rows = lines(docs)
    places = rows.select("k1", "k2", "place", "h1", "h2").join(
        cut(boilerplate(rows, min_sites).select("h1", "h2")), ["h1", "h2"]).groupBy("k1", "k2").agg(
        F.collect_set("place").alias("gone"))
    texts = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("k2"),
                        F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(places, ["k1", "k2"], "left").withColumn("parts", F.split("text", "\n", -1))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    # A set difference is linear in the lines of a document.
    stays = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), gone)
    return joined.select(
        "doc_id", F.size("parts").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.transform(
            stays, lambda i: F.get("parts", i)), "\n")).alias("text"))
