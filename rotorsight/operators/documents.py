"""From pages to structured records: clean, find headings and tables, cut into blocks.

A page row is (source, file_type, part, page, sheet_name, text): ``part`` numbers the pages,
sheets or segments of one source, one row each. Lines are ordered only inside a part. What reaches across parts
(section path, block numbers) is carried by ``runs.prefix`` over one small row per part, so a
source with very many pages is never gathered in one task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType)

from .. import limits as L
from ..functions.scalars import strip
from ..functions.text import clean_title, heading_level, matches, normalise
from ..session import materialise
from .runs import prefix

MAX_DEPTH = 15      # a heading line of at most 30 characters cannot be numbered deeper
PART = ["source", "part"]


def normalise_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", normalise("text"))


def edge_lines(text="text") -> Column:
    """Distinct non-blank lines among the first and last three of a page."""
    # Only the edges are split, not the page.
    edge = lambda k: F.split(F.substring_index(F.col(text), "\n", k), "\n")
    stripped = F.transform(F.concat(edge(L.HEADER_WINDOW), edge(-L.HEADER_WINDOW)),
                           lambda x: strip(x))
    return F.array_distinct(F.filter(stripped, lambda x: x != ""))


def edge_line_counts(pages: DataFrame) -> DataFrame:
    """Number of PDF pages on which a line stands near the top or bottom."""
    return (pages.filter(F.col("file_type") == "pdf").select(F.explode(edge_lines()).alias("line"))
            .groupBy("line").agg(F.count(F.lit(1)).alias("pages")))


def header_lines(pages: DataFrame, ratio: float = L.HEADER_MIN_RATIO) -> DataFrame:
    """Lines that count as page headers or footers.

    A page offers at most six candidates, so at most 6 / ratio lines can pass: ten by default.
    """
    total = pages.filter(F.col("file_type") == "pdf").agg(F.count(F.lit(1)).alias("n"))
    return (edge_line_counts(pages).withColumn("n", total.scalar())
            .filter((F.col("n") >= L.MIN_PAGES_FOR_HEADER) & (F.col("pages") >= ratio * F.col("n"))
                    & (F.length("line") <= L.HEADER_MAX_LEN)))


def drop_header_lines(pages: DataFrame, ratio: float = L.HEADER_MIN_RATIO) -> DataFrame:
    """Pages without the repeated lines; ``removed`` lists what was taken out.

    The header list (at most ten strings) is found once and is a scalar subquery, the removal is
    row-local. Only pages that hold one of the strings anywhere are taken apart.
    """
    listed = materialise(header_lines(pages, ratio).agg(F.collect_set("line").alias("lines")))
    lines = F.split("text", "\n")
    is_header = lambda x: F.array_contains(F.col("headers"), strip(x))
    suspect = F.exists("headers", lambda h: F.contains("text", h))
    removed = F.array_sort(F.array_distinct(F.transform(
        F.filter(lines, is_header), lambda x: strip(x))))
    kept = strip(F.array_join(F.filter(lines, lambda x: ~is_header(x)), "\n"))
    none = F.when(F.col("text").isNotNull(), F.array().cast("array<string>"))
    return (pages.withColumn("headers", listed.scalar())
            .withColumn("removed", F.when(suspect, removed).otherwise(none))
            .withColumn("text", F.when(F.size("removed") > 0, kept).otherwise(F.col("text")))
            .drop("headers"))


KINDS = ["text", "table", "list"]
_MD, _PIPE, _SEPARATOR, _ITEM = 1, 2, 4, 8


class _Lines(NamedTuple):
    """All non-blank lines of some pages in a row; counts start anew on every page."""

    page: np.ndarray        # which page of the batch
    number: np.ndarray      # the line's place on its page
    level: np.ndarray       # heading level by its form, or 0
    heading: np.ndarray     # and not an entry of a table of contents
    kind: np.ndarray        # place in KINDS
    starts: np.ndarray      # opens a block
    block: np.ndarray
    heading_no: np.ndarray
    chars: np.ndarray


def _judge(levels: pa.ListArray, flags: pa.ListArray, chars: pa.ListArray) -> _Lines:
    """Headings, kinds and blocks of the lines of each page, from the marks of single lines."""
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = chars.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    page = np.repeat(np.arange(len(sizes)), sizes)
    number = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    level, flag, length = flat(levels), flat(flags), flat(chars)
    shown = length > 0
    page, number, level, flag, length = (x[shown] for x in (page, number, level, flag, length))
    first = np.diff(page, prepend=-1) != 0

    def follows(value):
        return ~first & (value == np.roll(value, 1))

    def total(opens, value):
        """Sum of a value over the run that each line is in; runs begin where ``opens`` says."""
        run = np.cumsum(opens)
        return np.bincount(run, weights=value, minlength=1)[run]

    def count(value):
        running = np.cumsum(value)
        return running - (running - value)[first][np.cumsum(first) - 1] if len(value) else running

    pipe, ones = flag & _PIPE > 0, np.ones(len(page))
    in_toc = total(~(follows(level) & (level > 0)), ones) >= L.TOC_RUN_MIN
    markdown = total(first, flag & _MD) > 0
    next_pipe = pipe & follows(pipe) & (np.diff(number, prepend=-1) == 1)
    in_table = pipe & (total(~next_pipe, flag & _SEPARATOR) > 0)
    heading = (level > 0) & (markdown | ~in_toc)
    kind = np.where(heading, 0, np.where(in_table, 1, np.where(flag & _ITEM > 0, 2, 0)))
    starts = heading | ~follows(kind)
    return _Lines(page, number, level, heading, kind, starts, count(starts.astype(np.int64)),
                  count(heading.astype(np.int64)), length)


def _listed(pages: int, page: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
    ends = np.cumsum(np.bincount(page, minlength=pages)) if pages else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int32()),
        pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _list_of(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(k, v) for k, v in fields.items()]))


def _kinds(codes: np.ndarray) -> pa.Array:
    return pa.array(KINDS).take(pa.array(codes))


@F.arrow_udf(_list_of(line_no=IntegerType(), level=IntegerType(), heading=BooleanType(),
                      type=StringType(), block=LongType(), heading_no=LongType()))
def _line_marks(levels: pa.Array, flags: pa.Array, chars: pa.Array) -> pa.Array:
    x = _judge(levels, flags, chars)
    return _listed(len(chars), x.page, {
        "line_no": pa.array(x.number, pa.int32()),
        "level": pa.array(x.level, pa.int32(), mask=x.level == 0), "heading": pa.array(x.heading),
        "type": _kinds(x.kind), "block": pa.array(x.block), "heading_no": pa.array(x.heading_no)})


@F.arrow_udf(_list_of(block=LongType(), at=IntegerType(), lines=IntegerType(), size=LongType(),
                      level=IntegerType(), type=StringType(), heading_no=LongType()))
def _block_marks(levels: pa.Array, flags: pa.Array, chars: pa.Array) -> pa.Array:
    """Blocks with their first line and number of lines (blank ones too), size and heading level."""
    x = _judge(levels, flags, chars)
    at = np.nonzero(x.starts)[0]
    last = np.append(at[1:], len(x.page))[:len(at)] - 1
    held = np.concatenate([[0], np.cumsum(x.chars + 1)])
    return _listed(len(chars), x.page[at], {
        "block": pa.array(x.block[at]), "at": pa.array(x.number[at], pa.int32()),
        "lines": pa.array(x.number[last] - x.number[at] + 1, pa.int32()),
        "size": pa.array(held[last + 1] - held[at] - 1),
        "level": pa.array(x.level[at], pa.int32(), mask=~x.heading[at]),
        "type": _kinds(x.kind[at]), "heading_no": pa.array(x.heading_no[at])})


def page_lines(text="text") -> Column:
    """Stripped lines of a page, blank ones included; none of a null text."""
    return F.coalesce(F.transform(F.split(F.col(text), "\n"), lambda x: strip(x)),
                      F.array().cast("array<string>"))


def _marked(pages: DataFrame, marks) -> DataFrame:
    """Pages with ``lines`` and what ``marks`` makes of the form of every line. Row-local.

    The texts stay in the JVM: only three numbers per line go to the Python worker.
    """
    bit = lambda line, pattern, flag: F.when(matches(line, pattern), flag).otherwise(0)
    flags = lambda x: (
        bit(x, L.MD_HEADING_PATTERN, _MD) + F.when(~matches(x, L.TABLE_ROW_PATTERN), 0).otherwise(
            _PIPE + bit(x, L.TABLE_SEPARATOR_PATTERN, _SEPARATOR))
        + bit(x, L.LIST_ITEM_PATTERN, _ITEM))
    lines = pages.withColumn("lines", page_lines())
    return lines.withColumn("marks", marks(
        F.transform("lines", lambda x: F.coalesce(heading_level(x), F.lit(0))),
        F.transform("lines", flags), F.transform("lines", lambda x: F.length(x))))


def classify_lines(pages: DataFrame) -> DataFrame:
    """Non-blank lines with heading level, type and block number within their part.

    * three or more adjacent headings of one level are a table of contents and no headings,
      unless the part has Markdown headings;
    * adjacent pipe lines are a table only if one of them is a separator line;
    * a block starts at a heading and where the line type changes.

    A part is one row, so its lines are judged where they are read: no shuffle.
    """
    rows = _marked(pages, _line_marks).select(
        *PART, "file_type", "page", "sheet_name", F.explode(F.transform("marks", lambda m: F.struct(
            m.alias("m"), F.get("lines", m["line_no"]).alias("line")))).alias("x"))
    rows = rows.select(*PART, "file_type", "page", "sheet_name", "x.m.*", "x.line")
    return rows.select(
        *PART, "file_type", "page", "sheet_name", "line_no", "line",
        F.when(F.col("level").isNotNull(), clean_title("line")).alias("title"),
        F.length("line").alias("chars"), "level", "heading", "type", "block", "heading_no")


def outline(pages: DataFrame) -> DataFrame:
    """One small row per part with text: its blocks, its headings, and its longest blocks.

    Row-local and without the text; ``marks`` says where each block lies among the lines. A block
    starts with at most one heading.
    """
    titled = lambda m: m["level"].isNotNull()
    sizes = lambda test: F.array_max(F.transform(F.filter("marks", test), lambda m: m["size"]))
    heads = F.transform(F.filter("marks", titled), lambda m: F.struct(
        m["heading_no"].alias("heading_no"), m["level"].alias("level"),
        clean_title(F.get("lines", m["at"])).alias("title")))
    return materialise(_marked(pages, _block_marks).filter(F.size("marks") > 0).select(
        *PART, F.size("marks").cast("long").alias("blocks"), "marks", heads.alias("heads"),
        sizes(lambda m: F.lit(True)).alias("longest"),
        sizes(lambda m: m["heading_no"] > 0).alias("longest_titled")))


def heading_paths(parts: DataFrame) -> DataFrame:
    """Section path at every heading: (source, part, heading_no, level, title, depth, path).

    ``parts`` is the result of ``outline``. A heading pops the stack to below its level and is
    pushed, so its depth is ``min(depth before + 1, level)``. Unrolled, the depth of the j-th
    heading of a source is ``j + min(0, min over i <= j of (level_i - i))``, a running minimum;
    and the title at each depth is the last one put there. Both are prefix computations over
    parts.
    """
    heads = parts.select(*PART, F.explode("heads").alias("h")).select(*PART, "h.*")
    key, in_part = ["source"], W.partitionBy(*PART).orderBy("heading_no")
    so_far = in_part.rowsBetween(W.unboundedPreceding, 0)
    units = heads.groupBy(*PART).agg(F.count(F.lit(1)).alias("n"),
                                     F.min(F.col("level") - F.col("heading_no")).alias("low"))
    base = prefix(units, key, "part", {"n": "sum"}).withColumnRenamed("n", "base")
    based = materialise(units.join(base, PART).withColumn("low", F.col("low") - F.col("base")))
    lowest = prefix(based, key, "part", {"low": "min"}).withColumnRenamed("low", "low_before")
    at = F.col("base") + F.col("heading_no")
    deep = (heads.join(based.select(*PART, "base"), PART).join(lowest, PART)
            .withColumn("low", F.min(F.col("level") - at).over(so_far))
            .withColumn("depth", (at + F.least(F.lit(0), "low", "low_before")).cast("int")))
    deep = materialise(deep.select(*PART, "heading_no", "level", "title", "depth"))
    names = [f"t{d}" for d in range(1, MAX_DEPTH + 1)]
    title_at = lambda d: F.when(F.col("depth") == d, F.col("title"))
    last_titles = deep.groupBy(*PART).agg(*[
        F.max_by(title_at(d), F.when(F.col("depth") == d, F.col("heading_no"))).alias(n)
        for d, n in enumerate(names, 1)])
    carried = prefix(last_titles, key, "part", dict.fromkeys(names, "last"))
    own = deep.withColumns({f"own_{n}": F.last(title_at(d), ignorenulls=True).over(so_far)
                            for d, n in enumerate(names, 1)})
    stack = F.array(*[F.coalesce(f"own_{n}", n) for n in names])
    return own.join(carried, PART).select(
        *PART, "heading_no", "level", "title", "depth", F.slice(stack, 1, F.col("depth"))
        .alias("path"))


def locator_json() -> Column:
    """Locator as JSON text with sorted keys, as it enters the record id."""
    fields = F.concat_ws(", ", F.concat(F.lit('"page": '), F.col("page").cast("string")),
                         F.concat(F.lit('"sheet_name": '), F.lit('"'), F.col("sheet_name"),
                                  F.lit('"')))
    return F.concat(F.lit("{"), fields, F.lit("}"))


def records(pages: DataFrame) -> DataFrame:
    """Semantic blocks with section path, type, ordinal and stable id.

    The outline of every part is written without its text; everything carried between parts is
    small. The texts are read once more and meet it in one shuffle, a row per part. Blocks before
    the first heading of a source that has headings (cover, contents) are dropped.
    """
    parts = outline(pages)
    paths = materialise(heading_paths(parts).groupBy(*PART).agg(F.transform(F.array_sort(
        F.collect_list(F.struct("heading_no", "path"))), lambda x: x["path"]).alias("paths")))
    units = materialise(parts.drop("heads", "marks").join(paths.select(
        *PART, F.element_at("paths", -1).alias("open_path")), PART, "left"))
    before = materialise(prefix(units, ["source"], "part", {"blocks": "sum", "open_path": "last"}))
    # A source is titled when a block that is long enough stands under some heading.
    under = F.greatest("longest_titled", F.when(F.col("seen").isNotNull(), F.col("longest")))
    titled = (units.join(before.select(*PART, F.col("open_path").alias("seen")), PART)
              .groupBy("source").agg(F.coalesce(F.max(under >= L.MIN_RECORD_CHARS), F.lit(False))
                                     .alias("titled")))
    context = (before.join(titled, "source").join(parts.select(*PART, "marks"), PART)
               .join(paths, PART, "left"))
    texts = pages.select(*PART, "file_type", "page", "sheet_name", page_lines().alias("lines"))
    empty = F.array().cast("array<string>")
    block = lambda m: F.struct(
        (F.col("blocks") + m["block"]).alias("ordinal"), m["type"].alias("content_type"),
        F.coalesce(F.get("paths", (m["heading_no"] - 1).cast("int")), "open_path", empty)
        .alias("section_path"),
        F.array_join(F.filter(F.slice("lines", m["at"] + 1, m["lines"]), lambda x: x != ""), "\n")
        .alias("raw_text"))
    numbered = texts.join(context, PART).select(
        *PART, "file_type", "page", "sheet_name", "titled",
        F.explode(F.transform("marks", block)).alias("b")).select(
        *PART, "file_type", "page", "sheet_name", "titled", "b.*").withColumn(
        "char_count", F.length("raw_text"))
    kept = numbered.filter((F.col("char_count") >= L.MIN_RECORD_CHARS)
                           & ((F.size("section_path") > 0) | ~F.col("titled")))
    return kept.select(
        F.md5(F.concat_ws("\x1f", "source", locator_json(), F.col("ordinal").cast("string")))
        .alias("doc_id"), *PART, "file_type", "section_path", "content_type", "page",
        "sheet_name", "ordinal", "raw_text", "char_count")
