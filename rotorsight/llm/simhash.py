"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Distinct
fingerprints within ``RADIUS`` differing bits are linked. Two such fingerprints agree in at least
two of four 16-bit blocks, so each is dealt to six tables by a pair of blocks. A bucket with more
than ``BUCKET`` members is dealt again by pairs of 8-bit blocks of its free bits, which leaves 16
free bits, so at most 65,536 distinct members. Inside a bucket the bits stand in vertical planes,
64 members to a word; the distances to many members are counted with carry-save bit counters,
and a block of members is abandoned once all of it exceeds the radius. A bucket gives a spanning
forest of its links, not all its pairs, which leaves the components as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, id_text, text_hash

RADIUS = 2
SHINGLE_WORDS = 3
BUCKET = 4096
SEED = 42
#: Pairs (fingerprint, block of 64 members) that are compared at once.
PAIRS = 1 << 15


def fingerprint(text: bytes) -> int:
    """Lower-cases A-Z; words are runs outside ``[\\x20\\x09-\\x0D]``."""
    words = text.lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, SHINGLE_WORDS
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        ends = (ends - 1).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1:])]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("body"))
        out = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in texts], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(out.view(np.int64))],
            names=["doc_id", "k1", "k2", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row key, fingerprint as a signed long. Null texts count as empty (zero)."""
    rows = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("k2"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, k1 string, k2 long, fp long")


def planes(members: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: ``(blocks, 64)``, plane j holds bit j of each."""
    bits = np.unpackbits(members.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    flat = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(flat).view(np.uint64).reshape(-1, 64)


def within(queries: np.ndarray, blocks: np.ndarray, valid: np.ndarray, radius: int = RADIUS):
    """For each pair of a query and a block: a word with a bit per member within ``radius`` (0-3).

    ``c0`` and ``c1`` count differing bits in carry-save form, ``over`` saturates.
    """
    result = np.zeros(len(queries), np.uint64)
    alive = np.arange(len(queries))
    c0 = np.zeros(len(queries), np.uint64)
    c1, over = c0.copy(), ~valid
    zero, full = np.uint64(0), ~np.uint64(0)
    for j in range(64):
        ones = zero - (queries >> np.uint64(j) & np.uint64(1))
        differ = blocks[:, j] ^ ones
        carry = c0 & differ
        c0 ^= differ
        over |= c1 & carry
        c1 ^= carry
        if radius < 3:
            over |= (c1 & c0) if radius == 2 else c1 if radius == 1 else c1 | c0
        if j % 8 == 7 and j < 63:
            live = over != full
            if not live.all():
                alive, queries, blocks = alive[live], queries[live], blocks[live]
                c0, c1, over = c0[live], c1[live], over[live]
                if not len(alive):
                    return result
    result[alive] = ~over
    return result


def merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the classes of ``u`` and ``v``; a label is the smallest index of its class."""
    while True:
        a, b = labels[u], labels[v]
        if (a == b).all():
            return labels
        np.minimum.at(labels, a, b)
        np.minimum.at(labels, b, a)
        while True:
            nxt = labels[labels]
            if (nxt == labels).all():
                break
            labels = nxt


def forest(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels of members of consecutive buckets; ``starts`` ends with ``len(values)``."""
    sizes = np.diff(starts)
    n_blocks = -(-sizes // 64)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    slot = np.arange(len(values)) - np.repeat(starts[:-1] - first_block[:-1] * 64, sizes)
    padded = np.zeros(first_block[-1] * 64, np.uint64)
    padded[slot] = values
    owner = np.zeros(len(padded), np.int64)
    owner[slot] = np.arange(len(values))
    used = np.zeros(len(padded), np.uint8)
    used[slot] = 1
    valid = np.packbits(used, bitorder="little").view(np.uint64)
    vertical = np.concatenate([planes(padded[i * 64:(i + 2048) * 64])
                               for i in range(0, first_block[-1], 2048)])
    labels = np.arange(len(values))
    # A query meets the blocks of its bucket from its own on.
    own = slot // 64
    todo = np.repeat(first_block[1:], sizes) - own
    ends = np.cumsum(todo)
    for lo in range(0, int(ends[-1]), PAIRS):
        pair = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
        q = np.searchsorted(ends, pair, side="right")
        block = own[q] + pair - (ends[q] - todo[q])
        hits = within(values[q], vertical[block], valid[block])
        some = np.nonzero(hits)[0]
        bits = np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        labels = merge(labels, q[some][row], owner[block[some][row] * 64 + bit])
    return labels


def _links(batches):
    """Sorted rows (tab, key, sub, fp) -> spanning edges; a bucket may span several batches."""
    held = None

    def edges(rows):
        new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        starts = np.concatenate([np.nonzero(new)[0], [len(rows)]])
        values = rows[:, 3].copy()
        labels = forest(values.view(np.uint64), starts)
        moved = labels != np.arange(len(values))
        return pa.RecordBatch.from_arrays(
            [pa.array(values[moved]), pa.array(values[labels[moved]])], names=["u", "v"])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(i)) for i in range(4)], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        if not len(rows):
            continue
        same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
        at = len(rows) - int(same.sum())
        held = rows[at:]
        if at:
            yield edges(rows[:at])
    if held is not None and len(held):
        yield edges(held)


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints (column fp) that span all links."""
    distinct = prints.select("fp").distinct()
    block = lambda at, i, width: F.shiftrightunsigned(at, i * width).bitwiseAND((1 << width) - 1)
    tables = [F.struct(F.lit(t).cast("long").alias("tab"),
                       (block("fp", a, 16) * 65536 + block("fp", b, 16)).alias("key"),
                       (block("fp", c, 16) * 65536 + block("fp", d, 16)).alias("free"))
              for t, (a, b) in enumerate(combinations(range(4), 2))
              for c, d in [sorted({0, 1, 2, 3} - {a, b})]]
    dealt = distinct.select("fp", F.explode(F.array(*tables)).alias("e")).select("fp", "e.*")
    sizes = dealt.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sub = F.array(*[F.lit(s).cast("long") * 65536 + block("free", a, 8) * 256 + block("free", b, 8)
                    for s, (a, b) in enumerate(combinations(range(4), 2))])
    buckets = dealt.join(sizes, ["tab", "key"]).select(
        "tab", "key", F.explode(F.when(F.col("n") > BUCKET, sub).otherwise(
            F.array(F.lit(-1).cast("long")))).alias("sub"), "fp")
    return buckets.repartition("tab", "key", "sub").sortWithinPartitions(
        "tab", "key", "sub").mapInArrow(_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, k1, k2.

    ``component_id`` is the smallest doc_id (null ids only if there is no other) that links
    reach, the row itself included. Texts without words have fingerprint zero and link like any
    other. Repeated rows share a component. An empty table gives an empty result; other columns
    are not read.
    """
    prints = cut(fingerprints(docs))
    roots = components(links(prints)).select(F.col("node").alias("fp"), "root")
    owners = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    owners = owners.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = owners.groupBy("root").agg(F.min("least").alias("component_id"))
    named = owners.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "root", "k1", "k2")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the smallest doc_id, then the smallest text hash."""
    from .exact_dedup import keep_rows
    rows = near_duplicates(docs)
    best = rows.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "k2", "k1")).alias("b"))
    return keep_rows(docs, best.select("b.k1", "b.k2"))
