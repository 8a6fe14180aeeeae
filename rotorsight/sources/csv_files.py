"""CSV files of any size as rows: Spark splits the bytes, a prefix scan finds the records.

A line inside a quoted field does not begin a record, and only what stands before it tells. Each
line is therefore a function of the state in front of it (outside or inside quotes) to the state
behind it. Such functions compose, so the state before every line is a prefix over lines inside a
block of the file and, with one row per block, over the blocks of the file. No task sees more
than one block of text, however large the file is, and where the blocks are cut changes nothing.
"""

from __future__ import annotations

import csv
import io
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from .. import limits as L
from ..session import materialise

#: Characters of one record that runs over several lines; a longer one makes its file unreadable.
RECORD_CHARS = 16 << 20
FIELD_CHARS = 131072

GLOB = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in s) for s in L.CSV_SUFFIXES) + "}"


@F.pandas_udf(IntegerType())
def _decodable(raw: pd.Series) -> pd.Series:
    """Bit i is set if the i-th encoding can read the bytes."""
    def test(data):
        bits = 0
        for i, encoding in enumerate(L.CSV_ENCODINGS):
            try:
                bytes(data).decode(encoding)
                bits |= 1 << i
            except UnicodeDecodeError:
                pass
        return bits
    return raw.map(test, na_action="ignore").astype("Int32")


@F.pandas_udf(StringType())
def _decode(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else bytes(d).decode(e) for d, e in zip(raw, encoding)], dtype=object)


@F.pandas_udf(StructType().add("from_outside", BooleanType()).add("from_inside", BooleanType()))
def _ends_inside(line: pd.Series) -> pd.DataFrame:
    """Is the end of the line inside quotes, if its begin is outside or inside of them?"""
    csv.field_size_limit(sys.maxsize)

    def runs_on(text):
        reader = csv.reader([text + "\n", ""])
        next(reader)
        return reader.line_num == 2
    return pd.DataFrame([(None, None) if t is None else (runs_on(t), runs_on('"' + t)) for t in line],
                        columns=["from_outside", "from_inside"], dtype=object)


@F.pandas_udf(StructType().add("cells", ArrayType(StringType())).add("error", StringType()))
def _cells(record: pd.Series) -> pd.DataFrame:
    """The fields of one record; none for a blank one."""
    csv.field_size_limit(FIELD_CHARS)

    def parse(text):
        try:
            row = next(csv.reader(io.StringIO(text)), [])
        except csv.Error as broken:
            return None, f"not readable as CSV: {broken}"
        return (row if any(c.strip() for c in row) else None), None
    return pd.DataFrame([parse(t) for t in record], columns=["cells", "error"])


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Bytes between line feeds with their file, block and place; Spark decides on the blocks."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", GLOB)
             .option("lineSep", "\n").text(path))
    return lines.select(F.col("_metadata.file_path").alias("source"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.col("_metadata.file_size").alias("size"),
                        F.monotonically_increasing_id().alias("at"), "value")


def _encodings(raw: DataFrame) -> DataFrame:
    """One row per file: the first encoding that reads all of its lines, or null; is the last line
    ended."""
    plain = F.col("value").rlike(r"\A[\x00-\x7F]*\z")
    bits = F.coalesce(_decodable(F.when(~plain, F.col("value").cast("binary"))),
                      F.lit((1 << len(L.CSV_ENCODINGS)) - 1))
    ended = (F.sum(F.octet_length("value") + 1) == F.max("size")) | F.max_by(
        F.endswith("value", F.lit("\r")), F.struct("block", "at"))
    usable = raw.groupBy("source").agg(F.bit_and(bits).alias("usable"), ended.alias("ended"))
    first = F.coalesce(*(F.when(F.col("usable").bitwiseAND(1 << i) > 0, e)
                         for i, e in enumerate(L.CSV_ENCODINGS)))
    return materialise(usable.select("source", first.alias("encoding"), "ended"))


def _prefix(constant: Column, swaps: Column, before: W) -> tuple[Column, Column]:
    """State behind some steps: known (null: it depends on the begin) and flipped.

    A step sets the state to ``constant`` (null: it does not) or, if ``swaps``, turns it around.
    """
    turns = F.coalesce(F.sum(swaps.cast("long")).over(before), F.lit(0))
    last = F.last(F.when(constant.isNotNull(), F.struct(constant.alias("state"), F.col("_turns").alias("at"))),
                  ignorenulls=True).over(before)
    odd = F.pmod(turns - F.coalesce(last["at"], F.lit(0)), F.lit(2)) == 1
    return F.when(last.isNotNull(), last["state"] != odd), odd


def _with_states(rows: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Add known/flipped in front of each row (and after_*: behind it) of steps (constant, swaps)."""
    upto = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    turned = rows.withColumn("_turns", F.sum(F.col("swaps").cast("long")).over(upto))
    known, flipped = _prefix(F.col("constant"), F.col("swaps"), before)
    after_known, after_flipped = _prefix(F.col("constant"), F.col("swaps"), upto)
    return turned.withColumns({"known": known, "flipped": flipped, "after_known": after_known,
                               "after_flipped": after_flipped}).drop("_turns")


def _lines(raw: DataFrame, encodings: DataFrame) -> DataFrame:
    """Decoded lines with universal line ends and the quote states around them, written once."""
    read = raw.join(encodings.filter("encoding is not null").drop("ended"), "source")
    utf8 = F.col("encoding") == L.CSV_ENCODINGS[0]
    text = F.when(utf8, F.col("value")).otherwise(_decode(
        F.when(~utf8, F.col("value").cast("binary")), F.col("encoding")))
    ends = F.split(F.regexp_replace(text, r"\r\z", ""), "\r", -1)
    lines = read.select("source", "block", "at", F.posexplode(ends).alias("sub", "line"))
    first = F.row_number().over(W.partitionBy("source", "block").orderBy("at", "sub")) == 1
    mark = (F.col("block") == 0) & first & F.startswith(F.col("line"), F.lit("﻿"))
    lines = lines.withColumn("line", F.when(mark, F.expr("substring(line, 2)")).otherwise(F.col("line")))
    lines = lines.withColumn("ends", _ends_inside(F.when(F.contains("line", F.lit('"')), F.col("line"))))
    outside = F.coalesce(F.col("ends.from_outside"), F.lit(False))
    inside = F.coalesce(F.col("ends.from_inside"), F.lit(True))
    steps = lines.withColumns({
        "from_outside": outside, "from_inside": inside,
        "constant": F.when(outside == inside, outside), "swaps": outside & ~inside}).drop("ends")
    return materialise(_with_states(steps, ["source", "block"], ["at", "sub"]))


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: is its begin inside quotes, and whose record runs into it."""
    starts = lambda inside: F.count_if(~F.coalesce(
        F.col("known"), F.col("flipped") != F.lit(inside)))
    end = F.max_by(F.struct("after_known", "after_flipped"), F.struct("at", "sub"))
    units = lines.groupBy("source", "block").agg(
        end.alias("end"), starts(False).alias("from_out"), starts(True).alias("from_in"))
    steps = units.select("source", "block", "from_out", "from_in",
                         F.col("end.after_known").alias("constant"),
                         (F.col("end.after_known").isNull() & F.col("end.after_flipped")).alias("swaps"))
    placed = _with_states(steps, ["source"], ["block"]).withColumn(
        "inside", F.coalesce("known", "flipped")).withColumn(
        "starts", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")))
    earlier = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    home = F.last(F.when(F.col("starts") > 0, F.struct("block", "starts")), ignorenulls=True).over(earlier)
    return materialise(placed.select("source", "block", "inside", home.alias("home")))


def _records(lines: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """One row per record: source, the block it begins in, its number there, text; or too_long."""
    inside = F.coalesce(F.col("known"), F.col("inside") != F.col("flipped"))
    after = F.when(F.col("before"), F.col("from_inside")).otherwise(F.col("from_outside"))
    number = F.sum((~F.col("before")).cast("long")).over(
        W.partitionBy("source", "block").orderBy("at", "sub"))
    placed = lines.join(blocks, ["source", "block"]).withColumn("before", inside).withColumn(
        "number", number).withColumn("whole", ~F.col("before") & ~after)
    carried = F.col("number") == 0
    placed = placed.select(
        "source", F.when(carried, F.col("home.block")).otherwise(F.col("block")).alias("home"),
        F.when(carried, F.col("home.starts")).otherwise(F.col("number")).alias("number"),
        "whole", "block", "at", "sub", "line")
    key = ["source", "home", "number"]
    whole = placed.filter("whole").select(*key, F.col("line").alias("text"), F.lit(False).alias("too_long"))
    parts = placed.filter("not whole")
    long = materialise(parts.groupBy(*key).agg(F.sum(F.length("line") + 1).alias("chars"))
                       .filter(F.col("chars") > RECORD_CHARS).select(*key))
    joined = parts.join(long, key, "left_anti").groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "at", "sub", "line"))),
        lambda x: x["line"]), "\n").alias("text"))
    # A field that is never closed holds the last line end, too; other records do not mind it.
    closed = F.concat("text", F.when(F.col("ended"), "\n").otherwise(""))
    joined = joined.join(files.select("source", "ended"), "source")
    return whole.union(joined.select(*key, closed, F.lit(False))).union(
        long.select(*key, F.lit(None).cast("string"), F.lit(True)))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all CSV files below a folder: source, row_no, cells, header, error.

    Row 0 is the header; blank rows do not count. A file that no encoding or no CSV reader can
    read is one row with the reason, a file with blank rows only is one row of nulls; Spark lists
    no files of zero bytes. A record may run over any number of lines and blocks.
    """
    raw = _raw_lines(spark, path)
    encodings = _encodings(raw)
    lines = _lines(raw, encodings)
    records = _records(lines, _blocks(lines), encodings)
    parsed = materialise(records.withColumn("p", _cells(F.coalesce("text", F.lit("")))).select(
        "source", "home", "number", "p.cells", F.when(
            F.col("too_long"), F.lit(f"record of more than {RECORD_CHARS} characters")).otherwise(
            F.col("p.error")).alias("error")).filter("cells is not null or error is not null"))
    broken = parsed.filter("error is not null").groupBy("source").agg(
        F.min_by("error", F.struct("home", "number")).alias("error")).union(
        encodings.filter("encoding is null").select("source", F.lit("unknown encoding")))
    broken = materialise(broken)
    good = parsed.filter("cells is not null").join(broken, "source", "left_anti")
    counts = good.groupBy("source", "home").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("source").orderBy("home").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("source", "home", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    in_block = W.partitionBy("source", "home").orderBy("number")
    numbered = good.join(offsets, ["source", "home"]).select(
        "source", (F.col("offset") + F.row_number().over(in_block) - 1).alias("row_no"), "cells")
    begin = materialise(counts.groupBy("source").agg(F.min("home").alias("home")))
    headers = materialise(good.join(begin, ["source", "home"]).groupBy("source").agg(
        F.min_by("cells", "number").alias("header")))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", GLOB).load(path)
             .select(F.col("_metadata.file_path").alias("source")))
    rest = files.join(headers, "source", "left_anti").join(broken, "source", "left")
    none = lambda kind: F.lit(None).cast(kind)
    return numbered.join(headers, "source").select(
        "source", F.col("row_no").cast("int").alias("row_no"), "cells", "header",
        none("string").alias("error")).union(rest.select(
            "source", none("int"), none("array<string>"), none("array<string>"), "error"))
