"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by deleting white space (the characters ``[\\x20\\x09-\\x0D]``). Its bytes are
cut into chunks; each chunk has a polynomial hash modulo two primes, and hashes of neighbouring
chunks combine by ``h(xy) = h(x) * B ** len(y) + h(y)``. Texts with equal fingerprints are then
compared chunk by chunk with one row of their group, so a collision never merges two texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_text, text_hash

#: Two primes below 2 ** 31 and a base for each: fixed values.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
CHUNK = 1 << 16
SPACE = b" \t\n\x0b\x0c\r"
#: Members of a group of equal fingerprints that are compared in one join key.
GROUP_SLICE = 512

_POWERS = []


def powers() -> list[np.ndarray]:
    """Per prime ``B ** (CHUNK - 1) .. B ** 0``, by doubling."""
    if not _POWERS:
        for p, b in zip(PRIMES, BASES):
            row = np.ones(1, np.uint64)
            while len(row) < CHUNK:
                step = np.uint64(pow(b, len(row), p))
                row = np.concatenate([row, row * step % np.uint64(p)])
            _POWERS.append(row[:CHUNK][::-1].copy())
    return _POWERS


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """Polynomial hashes of at most ``CHUNK`` bytes; products stay below 2 ** 55."""
    data = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(data, row[CHUNK - len(data):])) % p
                 for p, row in zip(PRIMES, powers()))


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Hash of the concatenation, from the hashes of its parts."""
    return tuple((x * pow(b, right_len, p) + y) % p
                 for x, y, p, b in zip(left, right, PRIMES, BASES))


def fingerprint(data: bytes) -> tuple[int, int]:
    total = (0, 0)
    for at in range(0, len(data), CHUNK):
        piece = data[at:at + CHUNK]
        total = combine(total, chunk_hash(piece), len(piece))
    return total


def _fingerprints(batches):
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "f1", "f2", "text_sha256")}
        for value in batch.column(batch.schema.get_field_index("body")):
            data = value.as_buffer().to_pybytes().translate(None, SPACE)
            f1, f2 = fingerprint(data)
            for k, x in zip(out, (len(data), f1, f2, hashlib.sha256(data).hexdigest())):
                out[k].append(x)
        keep = [batch.column(i) for i in range(4)]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(out["n_bytes"], pa.int64()), pa.array(out["f1"], pa.int64()),
             pa.array(out["f2"], pa.int64()), pa.array(out["text_sha256"], pa.string())],
            names=["doc_id", "k1", "k2", "n_points", *out])


def _chunk_prints(batches):
    """Rows (k1, k2, no, chunk) -> (k1, k2, no, size, f1, f2) of the chunk without white space."""
    for batch in batches:
        chunks = [c.as_buffer().to_pybytes().translate(None, SPACE) for c in batch.column(3)]
        prints = [fingerprint(c) for c in chunks]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([len(c) for c in chunks], pa.int64()),
             pa.array([f for f, _ in prints], pa.int64()),
             pa.array([f for _, f in prints], pa.int64())],
            names=["k1", "k2", "no", "size", "f1", "f2"])


def _combined(batches):
    """Rows (k1, k2, chunks in order) -> (k1, k2, n_bytes, f1, f2) of the concatenation."""
    for batch in batches:
        out = []
        for chunks in batch.column(2):
            total, n = (0, 0), 0
            for c in chunks.as_py():
                total = combine(total, (c["f1"], c["f2"]), c["size"])
                n += c["size"]
            out.append((n, *total))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *[pa.array(c, pa.int64()) for c in columns]],
            names=["k1", "k2", "n_bytes", "f1", "f2"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: id, row key ``(k1, k2)``, code points, fingerprint, SHA-256 of the normalised text.

    A text of one chunk is hashed where it is read. The chunks of a longer one are dealt out, hashed
    by any task, and their hashes combine in order, so a huge text is not one task's loop. (Its
    SHA-256 cannot be composed and is one pass in the JVM.)
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("k2"),
                       F.char_length(text).cast("long").alias("n_points"),
                       text.cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    one = F.octet_length("body") <= CHUNK
    short = rows.filter(one).mapInArrow(
        _fingerprints, f"doc_id {kind}, k1 string, k2 long, n_points long, "
                       "n_bytes long, f1 long, f2 long, text_sha256 string")
    long = rows.filter(~one)
    places = F.sequence(F.lit(0), F.expr(f"cast((octet_length(body) - 1) div {CHUNK} as int)"))
    chunks = long.select("k1", "k2", "body", F.explode(places).alias("no")).select(
        "k1", "k2", "no", F.substring("body", F.col("no") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"))
    hashed = chunks.repartition("k1", "k2", "no").mapInArrow(
        _chunk_prints, "k1 string, k2 long, no int, size long, f1 long, f2 long")
    # Rows that repeat an id and a text give the same chunks; the set holds each of them once.
    whole = hashed.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(
        F.struct("no", "size", "f1", "f2"))).alias("chunks")).mapInArrow(
        _combined, "k1 string, k2 long, n_bytes long, f1 long, f2 long")
    norm = F.regexp_replace(F.col("body").cast("string"), r"[\x20\x09-\x0D]+", "")
    heads = long.select("doc_id", "k1", "k2", "n_points",
                        F.sha2(norm.cast("binary"), 256).alias("text_sha256"))
    return short.unionByName(heads.join(whole, ["k1", "k2"]))


KEY = ["f1", "f2", "n_bytes"]


def _differing(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows ``(k1, k2)`` whose text differs from their group's pivot: collisions, as a rule none.

    Members of a group are dealt out in slices of ``GROUP_SLICE``; each slice gets a copy of the
    pivot, so a group of any size is compared by many tasks, chunk by chunk.
    """
    rows = prints.select("k1", "k2", *KEY).distinct()
    groups = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2")).alias("pivot")).filter("n > 1")
    slices = F.ceil(F.col("n") / GROUP_SLICE).cast("int")
    members = rows.join(groups, KEY).select(
        "k1", "k2", *KEY, (F.struct("k1", "k2") == F.col("pivot")).alias("is_pivot"),
        slices.alias("slices"))
    texts = docs.select(id_text().alias("k1"), text_hash().alias("k2"), F.regexp_replace(
        F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary").alias("body"))
    texts = members.join(texts, ["k1", "k2"])
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((n_bytes - 1) div {CHUNK} as int)")))
    chunks = texts.select("k1", "k2", *KEY, "is_pivot", "slices", "body",
                          F.explode(places).alias("no")).withColumn(
        "chunk", F.substring("body", F.col("no") * CHUNK + 1, F.lit(CHUNK))).drop("body")
    copies = chunks.filter("is_pivot").select(
        *KEY, "no", F.col("chunk").alias("pivot_chunk"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).distinct()
    others = chunks.filter(~F.col("is_pivot")).withColumn(
        "slice", F.expr("cast(pmod(xxhash64(k1, k2), slices) as int)"))
    return others.join(copies, [*KEY, "no", "slice"]).filter(
        "chunk <> pivot_chunk").select("k1", "k2").distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, k1, k2.

    Of equal normalised texts the row with the most code points stays, then the smallest doc_id
    (null ids last). Null texts count as empty, and all empty texts are equal. Of rows that agree
    in id and length as well, exactly one is kept. ``group_size`` counts rows. An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs))
    apart = _differing(docs, prints).withColumn("apart", F.lit(True))
    rows = prints.join(apart, ["k1", "k2"], "left").withColumn(
        "cls", F.when(F.col("apart"), F.col("text_sha256")).otherwise(""))
    same = rows.groupBy(*KEY, "cls", "n_points", "k1", "k2").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"),
        F.count(F.lit(1)).alias("copies"))
    same = cut(same)
    best = same.groupBy(*KEY, "cls").agg(
        F.sum("copies").alias("group_size"),
        F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "k2")
              .alias("b")).alias("best"))
    best = best.select(*KEY, "cls", "group_size", F.col("best.doc_id").alias("keep_id"),
                       F.col("best.k2").alias("keep_hash"))
    # Files on both sides: Spark can then split a class that holds very many rows.
    joined = same.join(cut(best), [*KEY, "cls"])
    is_best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k2") == F.col("keep_hash"))
    return joined.select("doc_id", "keep_id", "group_size", "text_sha256", "k1", "k2",
                         is_best.alias("is_best"),
                         F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
                         ).select("doc_id", "keep_id", "group_size",
                                  (F.col("is_best") & (F.col("copy") == 1)).alias("kept"),
                                  "text_sha256", "k1", "k2")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs).filter("kept").select("k1", "k2")
    return keep_rows(docs, kept)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key ``(k1, k2)`` is in ``kept``, one row per key.

    Repeated rows (same id and text) are folded with a map-side combine before the join, which
    then needs no second shuffle of the texts.
    """
    fold = docs.groupBy(id_text().alias("k1"), text_hash().alias("k2")).agg(
        F.first(F.struct(*docs.columns)).alias("row"))
    return fold.join(kept, ["k1", "k2"], "left_semi").select("row.*")
