"""Benchmark decontamination as a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (an item of fewer words is one window). A
window is taken as the set of its shingles of three words (fewer, if it has fewer), ordered by
their rarity in the documents. The whole window must occur, so its rarest shingle is the
necessary prefix; windows and documents are joined on it. In a document the shingle fixes where
the window stands: the bounds of the document are checked, then the window's words themselves.

Documents are read twice: to count the benchmark's shingles, and for the places of prefix
shingles, which carry the few words around them. Both passes leave out other shingles by a Bloom
filter of fixed size; it only saves rows, the joins decide. Nothing else reaches a task whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, hot_keys, id_text, text_hash

WINDOW = 10
SHINGLE = 3
#: Longer words are replaced by a digest with a byte no word has, so a row's words are bounded.
LONG_WORD = 64
#: The Bloom filter has 16 bits a shingle and at most 2 ** 21 words of 64 bits (16 MB).
MAX_SLOTS_LOG = 21
#: Places in one row of the second pass, and rows a key may have before it is dealt out.
PLACES, HOT_SHARE, SALTS = 1000, 1 / 256, 64

#: Bytes outside words become spaces, A-Z are lower-cased; bytes of non-ASCII characters are words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    row = text.translate(_WORD_BYTES).split()
    if len(text) > LONG_WORD:
        row = [w if len(w) <= LONG_WORD else
               b"\x01" + hashlib.blake2b(w, digest_size=24).hexdigest().encode() for w in row]
    return row


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words, as signed 64-bit numbers; one for each start."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def word_hashes(row: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, row), np.uint64, len(row))


def _bodies(batch):
    for value in batch.column(batch.schema.get_field_index("body")):
        yield value.as_buffer().to_pybytes()


def _batch_shingles(batch, sizes):
    """Words of a batch, end of each document in them, and per size (starts, hashes)."""
    rows, ends, total = [], [], 0
    for body in _bodies(batch):
        rows.append(words(body))
        total += len(rows[-1])
        ends.append(total)
    hashes = word_hashes([w for row in rows for w in row])
    ends = np.asarray(ends, np.int64)
    found = []
    for size in sizes:
        values = shingles(hashes, size)
        starts = np.arange(len(values))
        inside = starts + size <= ends[np.searchsorted(ends, starts, side="right")]
        found.append((starts[inside], values[inside]))
    return rows, ends, found


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, win, size, shingles) and their owners (wid, item_id)."""
    def cut_windows(batches):
        for batch in batches:
            items = batch.column(0)
            out = {"item_id": [], "win": [], "size": [], "shingles": []}
            for item, body in zip(items, _bodies(batch)):
                row = words(body)
                size = min(WINDOW, len(row))
                if not size:
                    continue
                k = min(SHINGLE, size)
                marks = shingles(word_hashes(row), k)
                for at in range(len(row) - size + 1):
                    out["item_id"].append(item.as_py())
                    out["win"].append(b" ".join(row[at:at + size]).decode())
                    out["size"].append(size)
                    out["shingles"].append(marks[at:at + size - k + 1].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item_id"], pa.string()), pa.array(out["win"], pa.string()),
                 pa.array(out["size"], pa.int32()), pa.array(out["shingles"], pa.list_(pa.int64()))],
                names=list(out))

    items = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("body"))
    rows = cut(items.mapInArrow(
        cut_windows, "item_id string, win string, size int, shingles array<bigint>")
        .withColumn("wid", F.md5("win")))
    distinct = rows.groupBy("wid").agg(*[F.first(c).alias(c) for c in ("win", "size", "shingles")])
    return cut(distinct), cut(rows.select("wid", "item_id").distinct())


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """Blocked Bloom filter of the column ``shingle``: two bits in one of at most 2 ** 21 words."""
    log = min(MAX_SLOTS_LOG, max(6, (n // 4).bit_length()))
    bit = lambda expr: f"shiftleft(1L, cast({expr} & 63 as int))"
    filled = hashes.select(
        F.expr(f"shiftrightunsigned(shingle, {64 - log})").alias("slot"),
        F.expr(f"{bit('shingle')} | {bit('shiftright(shingle, 6)')}").alias("bits"))
    filled = filled.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << log, np.uint64)
    table[filled["slot"].to_numpy()] = filled["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return table


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    h = values.view(np.uint64)
    slot = table[(h >> np.uint64(64 - (len(table).bit_length() - 1))).astype(np.int64)]
    six = np.uint64(63)
    return ((slot >> (h & six)) & (slot >> ((h >> np.uint64(6)) & six)) & np.uint64(1)).astype(bool)


def _shingle_counts(rows: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """Occurrences in all documents of shingles that pass the filter: (shingle, n)."""
    def count(batches):
        for batch in batches:
            _, _, found = _batch_shingles(batch, sizes)
            values = np.concatenate([np.empty(0, np.int64), *(v for _, v in found)])
            values, n = np.unique(values[passes(table, values)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n, pa.int64())],
                                             names=["shingle", "n"])

    return rows.select("body").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n"))


def prefixes(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their rarest shingle and its place: (shingle, at, wid, win, size).

    A shingle that no document has makes its window impossible; such windows are left out.
    """
    parts = distinct.select("wid", F.posexplode("shingles").alias("at", "shingle"))
    rarest = parts.join(counts, "shingle", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "shingle")).alias("p"))
    return distinct.join(rarest, "wid").filter("p.n > 0").select(
        "p.shingle", "p.at", "wid", "win", "size")


def _places(rows: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """Per document a row with n_words and places of prefix shingles; more rows for more places.

    A place holds the shingle, its position, and the words from ``left`` words before it on
    that a window with this shingle can reach.
    """
    def scan(batches):
        place = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int64()),
                                    ("left", pa.int32()), ("near", pa.string())]))
        for batch in batches:
            lists, ends, found = _batch_shingles(batch, sizes)
            at = [[] for _ in lists]
            for starts, values in found:
                keep = passes(table, values)
                owner = np.searchsorted(ends, starts[keep], side="right")
                for doc, pos, value in zip(owner.tolist(), starts[keep].tolist(),
                                           values[keep].tolist()):
                    row = lists[doc]
                    pos -= int(ends[doc]) - len(row)
                    low = max(0, pos - WINDOW + 1)
                    at[doc].append({"shingle": value, "pos": pos, "left": pos - low,
                                    "near": b" ".join(row[low:pos + WINDOW]).decode()})
            take, counts, parts = [], [], []
            for doc, spots in enumerate(at):
                for i in range(0, max(1, len(spots)), PLACES):
                    take.append(doc)
                    counts.append(len(lists[doc]) if i == 0 else None)
                    parts.append(spots[i:i + PLACES])
            ids = batch.select(["doc_id", "k1", "k2"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(counts, pa.int64()), pa.array(parts, place)],
                names=["doc_id", "k1", "k2", "n_words", "places"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, k1 string, k2 long, n_words long, "
                                 "places array<struct<shingle: bigint, pos: bigint, left: int, "
                                 "near: string>>")


def salted_join(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join; rows of ``many`` with a hot key are dealt out, ``few`` repeats rows of these.

    Fewer than ``1 / HOT_SHARE`` keys can be hot, whatever the size, so they are plain values.
    """
    hot = [r[key] for r in hot_keys(many, [key], HOT_SHARE).select(key).collect()]
    salts = F.when(F.col(key).isin(hot), SALTS).otherwise(1)
    left = many.withColumn("salts", salts).withColumn(
        "salt", F.expr("cast(pmod(xxhash64(k1, k2), salts) as int)")).drop("salts")
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "salt"]).drop("salt")


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, k1, k2, n_words), occurrences (k1, k2, start, size, wid), owners."""
    rows = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("k2"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    distinct, owners = windows(benchmark)
    sizes = sorted(min(SHINGLE, r["size"]) for r in distinct.select("size").distinct().collect())
    sizes = sorted(set(sizes))
    parts = distinct.select(F.explode("shingles").alias("shingle"))
    counts = cut(_shingle_counts(rows, bloom(parts, parts.count()), sizes))
    first = cut(prefixes(distinct, counts))
    scanned = cut(_places(rows, bloom(first, first.count()), sizes))
    places = scanned.select("k1", "k2", F.explode("places").alias("p")).select("k1", "k2", "p.*")
    met = salted_join(places, first, "shingle")
    # Bounds of the document first, then the words themselves.
    near = F.split("near", " ")
    skip = F.col("left") - F.col("at")
    met = met.filter((skip >= 0) & (skip + F.col("size") <= F.size(near)) & (
        F.array_join(F.slice(near, skip + 1, F.col("size")), " ") == F.col("win")))
    met = cut(met.select("k1", "k2", (F.col("pos") - F.col("at")).alias("start"), "size", "wid")
              .distinct())
    return scanned.filter("n_words is not null").drop("places"), met, owners


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, k1, k2, n_words, hits (word places, ascending), items.

    Null texts have no words; items without an id or a text are skipped; items with equal ids
    count once, and so do repeated rows of ``docs``. An empty benchmark gives rows without hits,
    an empty table of documents none. A document's places are ordered in one task, so memory is
    bounded by the longest text. Other columns are not read.
    """
    rows, met, owners = occurrences(docs, benchmark)
    # Each occurrence adds the places behind the end of those that start before it.
    spans = met.groupBy("k1", "k2", "start").agg(
        F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.expr("coalesce(max(end) over (partition by k1, k2 order by start "
                    "rows between unbounded preceding and 1 preceding), 0L)")
    spans = spans.withColumn("from", F.greatest("start", before)).filter("`from` < end")
    hits = spans.groupBy("k1", "k2").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("from", "end"))),
        lambda s: F.sequence(s["from"], s["end"] - 1))).cast("array<int>").alias("hits"))
    items = salted_join(met.select("k1", "k2", "wid").distinct(), owners, "wid").groupBy(
        "k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = hits.join(items, ["k1", "k2"])
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", "n_words", none("hits", "int"), none("items", "string"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns, one row per id and text."""
    from .exact_dedup import keep_rows
    rows = contamination(docs, benchmark)
    return keep_rows(docs, rows.filter(F.size("items") == 0).select("k1", "k2"))
