"""Chunks of records: row-local splitting, stable ids, upsert."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import limits as L
from ..functions.scalars import strip

LIST_ITEM = re.compile(L.LIST_ITEM_PATTERN)
TABLE_SEPARATOR = re.compile(L.TABLE_SEPARATOR_PATTERN)


def _stretches(text: str, separators: list[str]):
    """Stretches of a text with the ends of their parts, from 0; parts of one stretch may be packed.

    A separator opens a part. A part as long as a chunk is cut by the finer separators, of which
    the last is empty and cuts between characters, and is never packed with its neighbours.
    """
    level = next(i for i, s in enumerate(separators) if not s or s in text)
    mark, finer = separators[level], separators[level + 1:]
    if not mark:
        yield text, range(len(text) + 1)
        return
    first, *rest = text.split(mark)
    sizes = ([len(first)] if first else []) + [len(mark) + n for n in map(len, rest)]
    ends, low = [0, *accumulate(sizes)], 0
    for i in [i for i, n in enumerate(sizes) if n >= L.CHUNK_SIZE] + [len(sizes)]:
        if i > low:
            yield text[ends[low]:ends[i]], [e - ends[low] for e in ends[low:i + 1]]
        if i < len(sizes):
            yield from _stretches(text[ends[i]:ends[i + 1]], finer)
        low = i + 1


def split_text(text: str) -> list[str]:
    """Pack parts into chunks of at most 500 characters that repeat up to 80 of the one before.

    A step per chunk, not per part: the ends of parts are searched.
    """
    chunks = []
    for held, ends in _stretches(text, L.SEPARATORS):
        low = 0
        while (high := bisect_right(ends, ends[low] + L.CHUNK_SIZE) - 1) < len(ends) - 1:
            chunks.append(held[ends[low]:ends[high]])
            room = min(L.CHUNK_OVERLAP, L.CHUNK_SIZE - (ends[high + 1] - ends[high]))
            low = bisect_left(ends, ends[high] - room, low, high)
        chunks.append(held[ends[low]:])
    return [c for c in map(str.strip, chunks) if c]


def _packed(items: list[str]) -> list[list[str]]:
    """Consecutive items in groups of at most 500 characters; a longer item stands alone."""
    groups, size = [[]], 0
    for item in items:
        if groups[-1] and size + len(item) > L.CHUNK_SIZE:
            groups.append([])
            size = 0
        groups[-1].append(item)
        size += len(item)
    return [g for g in groups if g]


def split_table(text: str) -> list[str]:
    """Whole table if short, else groups of rows with the header repeated."""
    if len(text) <= L.MAX_TABLE_CHARS:
        return [text]
    rows = text.split("\n")
    head = 2 if len(rows) > 1 and TABLE_SEPARATOR.match(rows[1].strip()) else 1
    return ["\n".join(rows[:head] + group) for group in _packed(rows[head:])]


def split_list(text: str) -> list[str]:
    """Cut only between list items; an item that is too long is split like text."""
    if len(text) <= L.CHUNK_SIZE:
        return [text]
    items: list[str] = []
    for line in text.split("\n"):
        if items and not LIST_ITEM.match(line):
            items[-1] += "\n" + line
        else:
            items.append(line)
    return [piece for group in _packed(items) for piece in split_text("\n".join(group))]


SPLITTERS = {"table": split_table, "list": split_list, "text": split_text}


@F.pandas_udf(ArrayType(StringType()))
def _split(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else SPLITTERS.get(k, split_text)(t)
                      for k, t in zip(kinds, texts)])


def chunks(records: DataFrame) -> DataFrame:
    """One row per chunk. Records that fit in one chunk never leave the JVM."""
    kind = F.col("content_type")
    fits = F.col("char_count") <= F.when(kind == "table", L.MAX_TABLE_CHARS) \
        .otherwise(L.CHUNK_SIZE)
    whole = F.when(kind.isin("table", "list"), F.array("raw_text")).otherwise(
        F.filter(F.array(strip("raw_text")), lambda x: x != ""))
    pieces = F.coalesce(_split(kind, F.when(~fits, F.col("raw_text"))), whole)
    rows = records.select(
        "doc_id", "source", "file_type", "section_path", "content_type", "page", "sheet_name",
        F.posexplode(pieces).alias("chunk_index", "text"))
    return rows.withColumns({
        "char_count": F.length("text"),
        "chunk_id": F.md5(F.concat_ws("::", "doc_id", F.col("chunk_index").cast("string"),
                                      F.substring("text", 1, 64)))})


def flat_metadata(rows: DataFrame) -> DataFrame:
    """Metadata as scalars: path joined by ' > ', missing values as empty text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(
        "chunk_id", "doc_id", "text", text("source").alias("source"),
        text("file_type").alias("file_type"),
        F.array_join("section_path", " > ").alias("section_path"),
        text("content_type").alias("content_type"), "char_count", text("page").alias("page"),
        text("sheet_name").alias("sheet_name"))


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored chunks with the fresh ones over them, one row per chunk id.

    A partial aggregate: many copies of one chunk are reduced before the shuffle. Every column is
    an aggregate of its own under one order of the rows (version, then a hash of the row, so that
    all columns come from one copy), so columns that nobody reads are neither sorted nor shuffled.
    """
    columns = [c for c in fresh.columns if c != "chunk_id"]
    both = stored.select("chunk_id", *columns).withColumn("version", F.lit(0)).unionByName(
        fresh.withColumn("version", F.lit(1)))
    ranked = both.withColumn("rank", F.struct("version", F.xxhash64(*columns)))
    return ranked.groupBy("chunk_id").agg(*[F.max_by(c, "rank").alias(c) for c in columns])
