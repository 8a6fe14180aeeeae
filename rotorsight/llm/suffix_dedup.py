"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

A rolling hash triggers at its minimum in each window of ``GAP`` places: a string of ``LENGTH``
bytes that occurs twice has the same trigger in both places. The trigger that is responsible for
a run of such strings makes one phrase: the bytes of that run. Neighbouring phrases overlap by
``LENGTH`` bytes, so no suffix of a phrase that is at least that long is a prefix of another one
with a different continuation within the depth that matters.

The dictionary holds the distinct phrases, the parse says where they occur. Phrases that occur
twice repeat as a whole. The others share strings at most with phrases of the same seed (the
``SEED_BYTES`` bytes from the trigger on). The strings of such phrases (suffixes of the dictionary
to a depth of ``LENGTH``) fall into classes of equal ones in two refinements, both plain
aggregations over all of them, so that no group of phrases ever meets in one task:

* bands of ``WIDTH`` neighbouring strings, at fixed distances from the trigger. Bands that cover
  equal bytes repeat as a whole, and one of them stands for all from there on; bands whose common
  bytes occur in no other phrase repeat nowhere. Both are then decided.
* the single strings of the bands left over.

Because phrases overlap by that depth, the parse only has to supply how often and where phrases
occur. Classes, not the order between them, are what decides; a sorted array of all suffixes is not
kept. Phrases are told apart by 128 bits (seed and phrase), bands and strings by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text, text_hash

LENGTH = 400
#: Bytes of the rolling hash; places per trigger window; bytes of a seed.
ROLL = 8
GAP = 200
SEED_BYTES = LENGTH - GAP
#: Neighbouring strings of a phrase that are compared at once.
WIDTH = 16


def triggers(data: np.ndarray, gap: int = GAP) -> np.ndarray:
    """Per start of a string of ``LENGTH`` bytes the place of the trigger responsible for it.

    The place of the smallest rolling hash in ``[p, p + gap - ROLL]``, the first one of equals.
    """
    words = np.ndarray(len(data) - ROLL + 1, "<u8", data.tobytes(), strides=(1,))
    mixed = words * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    rank = mixed >> np.uint64(32) << np.uint64(32) | np.arange(len(words), dtype=np.uint64)
    width, span = gap - ROLL + 1, 1
    while span * 2 <= width:          # minimum over span places, then over width places
        rank = np.minimum(rank[:-span], rank[span:])
        span *= 2
    if width > span:
        rank = np.minimum(rank[:span - width], rank[width - span:])
    return (rank & np.uint64(0xFFFFFFFF)).astype(np.int64)[:len(data) - LENGTH + 1]


def phrases(data: bytes):
    """Rows (seed hash, phrase hash, trigger - low, low, high): strings start in low..high."""
    if len(data) < LENGTH:
        return []
    at = triggers(np.frombuffer(data, np.uint8))
    new = np.nonzero(np.diff(at))[0] + 1
    lows = [0, *new.tolist()]
    highs = [*(new - 1).tolist(), len(at) - 1]
    digest = xxhash.xxh3_64_intdigest
    return [(digest(data[t:t + SEED_BYTES]), digest(data[lo:hi + LENGTH]), t - lo, lo, hi)
            for t, lo, hi in zip(at[lows].tolist(), lows, highs)]


def _parse(batches):
    names = ["k1", "k2", "seed", "phrase", "back", "low", "high"]
    for batch in batches:
        owner, rows = [], []
        for i, x in enumerate(batch.column(2)):
            found = phrases(x.as_buffer().to_pybytes())
            owner.extend([i] * len(found))
            rows.extend(found)
        keys = batch.select([0, 1]).take(pa.array(owner, pa.int64()))
        seed, phrase, back, low, high = zip(*rows) if rows else [()] * 5
        long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*keys.columns, long(seed), long(phrase),
             *(pa.array(v, pa.int32()) for v in (back, low, high))], names=names)


def parse(texts: DataFrame) -> DataFrame:
    """Rows (k1, k2, body) -> one row per phrase: k1, k2, seed, phrase, back, low, high."""
    return texts.select("k1", "k2", "body").mapInArrow(
        _parse, "k1 string, k2 long, seed long, phrase long, back int, low int, high int")


def bands(body: bytes, back: int):
    """Rows (first, last, narrow, wide) of the bands of a phrase whose trigger is at ``back``.

    Strings start in first..last. ``narrow`` is a hash of the bytes that every string of the band
    holds wherever it occurs, ``wide`` a digest of the bytes that the strings here cover. Equal
    hashes of different bytes cost a comparison, no more.
    """
    hashed, digest, near = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, \
        back - (len(body) - LENGTH)
    for start in range(near - near % WIDTH, back + 1, WIDTH):
        end = start + WIDTH - 1
        lo, hi = max(start, near), min(end, back)
        yield (back - hi, back - lo, hashed(body[back - start:back - end + LENGTH], seed=start),
               digest(body[back - hi:back - lo + LENGTH], seed=lo * LENGTH + hi))


_PLACE = "k1 string, k2 long, low int"


def _bands(batches):
    """Rows (k1, k2, low, once, back, body) -> (k1, k2, low, once, first, last, narrow, wide)."""
    for batch in batches:
        owner, rows = [], []
        for i, (low, back, x) in enumerate(zip(
                batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5))):
            found = [(low + a, low + b, n, w) for a, b, n, w in bands(x.as_py(), back)]
            owner.extend([i] * len(found))
            rows.extend(found)
        cols = list(zip(*rows)) if rows else [()] * 4
        narrow = pa.array(np.array(cols[2], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*batch.select([0, 1, 2, 3]).take(pa.array(owner, pa.int64())).columns,
             pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), narrow,
             pa.array(cols[3], pa.binary())],
            names=["k1", "k2", "low", "once", "first", "last", "narrow", "wide"])


def _strings(batches):
    """Rows (k1, k2, low, bands, body) -> (k1, k2, first, open, digest) per string of a band."""
    for batch in batches:
        owner, rows = [], []
        for i, (low, parts, x) in enumerate(zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4))):
            body = x.as_py()
            found = [(q, part["open"], xxhash.xxh3_128_digest(body[q - low:q - low + LENGTH]))
                     for part in parts for q in range(part["first"], part["last"] + 1)]
            owner.extend([i] * len(found))
            rows.extend(found)
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [*batch.select([0, 1]).take(pa.array(owner, pa.int64())).columns,
             *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary())))],
            names=["k1", "k2", "first", "open", "digest"])


def _cut_out(batches):
    """Rows (k1, k2, lows, highs, body): the spans low..high + LENGTH - 1 leave the body."""
    for batch in batches:
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for lows, highs, x in zip(*(batch.column(i) for i in (3, 4, 5))):
            body = x.as_buffer().to_pybytes()
            stay, gone, count, end = [], 0, 0, 0
            last = -1
            for lo, hi in sorted(zip(lows.as_py() or (), highs.as_py() or ())):
                hi += LENGTH
                if lo > last:
                    count += 1
                    stay.append(body[end:lo])
                    last = end = hi
                elif hi > last:
                    last = end = hi
            stay.append(body[end:])
            text = b"".join(stay)
            sizes.append(len(body))
            removed.append(len(body) - len(text))
            spans.append(count)
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v, pa.int64()) for v in (sizes, removed, spans)),
             pa.array(digests), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Rows (k1, k2, body) -> (k1, k2, low, high): strings that start in low..high repeat.

    ``texts`` may hold a row key twice (repeated rows); its strings then repeat.
    """
    keys = ["seed", "phrase"]
    places = cut(parse(texts))
    seeds = places.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), (F.min("phrase") != F.max("phrase")).alias("mixed")
        ).filter("n > 1")
    # Written first: a join with files on both sides is one whose hot keys Spark can split.
    shared = cut(places.join(cut(seeds.select("seed", "mixed")), "seed"))
    whole = shared.filter("not mixed").select("k1", "k2", "low", "high")
    mixed = shared.filter("mixed").drop("mixed")
    # The dictionary: each distinct phrase with one place to read it from, and whether it is alone.
    words = cut(mixed.groupBy("seed", "phrase").agg(
        (F.count(F.lit(1)) == 1).alias("once"),
        F.min(F.struct("k1", "k2", "low", "high", "back")).alias("at")).select("once", "at.*"))
    place = ["k1", "k2", "low"]
    # Joined by place, not by phrase: a phrase may hold very many places, a place holds one phrase.
    twice = mixed.join(words.filter("once").select(*place), place, "left_anti").select(
        *place, "high")
    wanted = words.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("low", "high", "back", "once")).alias("ws"))
    bodies = cut(texts.join(wanted, ["k1", "k2"]).select(
        "k1", "k2", "body", F.explode("ws").alias("w")).select(
        "k1", "k2", "w.low", "w.once", "w.back", F.substring(
            "body", F.col("w.low") + 1, F.col("w.high") - F.col("w.low") + LENGTH).alias("body")))
    parts = cut(bodies.mapInArrow(
        _bands, f"{_PLACE}, once boolean, first int, last int, narrow long, wide binary"))
    classes = cut(parts.groupBy("narrow", "wide").agg(
        F.count(F.lit(1)).alias("n"), F.min("once").alias("once"),
        F.min(F.struct(*place, "first", "last")).alias("at")))
    equal = parts.filter("once").join(
        classes.filter("n > 1").select("wide"), "wide").select("k1", "k2", "first", "last")
    # Bands that share their common bytes with others: one of each class goes on.
    alone = F.col("once") & (F.col("n") == 1)
    near = cut(classes.groupBy("narrow").agg(
        F.count(F.lit(1)).alias("n"), F.max(alone).alias("open")).filter("n > 1 and open"))
    rest = classes.withColumn("open", alone).join(near.select("narrow"), "narrow").select(
        "at.*", "open").groupBy(*place).agg(
        F.collect_list(F.struct("first", "last", "open")).alias("bands"))
    strings = cut(bodies.select(*place, "body").join(rest, place).select(
        *place, "bands", "body").mapInArrow(
        _strings, "k1 string, k2 long, first int, open boolean, digest binary"))
    seen = cut(strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
               .select("digest"))
    single = strings.filter("open").join(seen, "digest").select(
        "k1", "k2", "first", F.col("first").alias("last"))
    return whole.union(twice).union(equal).union(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are UTF-8 bytes, null counts as empty; strings of ``LENGTH`` bytes never cross
    documents, and texts shorter than that stay. Overlapping occurrences count, the same document
    included; rows that repeat as a whole are documents of their own. ``kept`` (binary) is the
    rest of the text. Other columns are not read.
    """
    rows = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("k2"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    spans = repeated_spans(rows.select("k1", "k2", "body")).distinct().groupBy("k1", "k2").agg(
        F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.join(spans, ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"),
        "body")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, "
                                       "kept_sha256 string, kept binary")
