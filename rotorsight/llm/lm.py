"""Stupid-backoff language-model scores of every document, from counts over all documents.

A bigram (v, w) of a document scores c'(v w) / c(v) where c' leaves the document itself out, and
``ALPHA`` * c(w) / N where c' is zero; a document's score is the mean of the binary logarithms.

Tables of n-gram counts are partitioned by hash: a bucket gets all bigrams whose first word falls
into it, from packs of documents, each distinct bigram of a pack once with its documents. There
the bigrams are counted, joined back to the documents and summed. Bigrams not found elsewhere go
on to the bucket of their second word, where its count is. A last step adds up the partial sums of
each pack. Words and bigrams with more than 1 / ``HOT`` of all tokens are counted beforehand and
broadcast (at most 2 * ``HOT`` of each, at any size of the data); hot bigrams are scored where they
are read, and those with a hot first word are spread over buckets by the whole bigram.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut

ALPHA = 0.4
HOT = 1 << 16
#: Documents and bytes of a pack, tokens of a bucket.
PACK_DOCS = 5000
PACK_BYTES = 8 << 20
BUCKET_TOKENS = 1_000_000
DECIMALS = 6

#: Bytes of partial sums that a task holds before it passes them on.
SUM_BYTES = 16 << 20

#: Stands after the last word of a document, so that every word is first in one bigram.
END = np.uint64(0)
U64, I64 = np.uint64, np.int64
#: Words are told apart by so many bytes of their hash; between tasks they travel in these bytes.
WORD_BYTES = 7
WORD_MASK = (1 << 8 * WORD_BYTES) - 1


def thin(hashes: np.ndarray) -> np.ndarray:
    """Word hashes as rows of ``WORD_BYTES`` bytes."""
    return np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").ravel()


def mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of word hashes."""
    x = first * U64(0x9E3779B97F4A7C15) + second
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> U64(shift)) * U64(factor)
    return x ^ x >> U64(31)


def bigrams(bodies: list[bytes]):
    """Word hashes, sorted distinct (first, second, document) with counts, words per document.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. ``first`` and ``second``
    are places in the hashes, of which the last is ``END``.
    """
    known: dict[bytes, int] = {}
    words, sizes = [], np.zeros(len(bodies), I64)
    for i, body in enumerate(bodies):
        row = [known.setdefault(w, len(known)) for w in body.lower().split()]
        sizes[i] = len(row)
        words.extend(row)
        if row:
            words.append(-1)
    n, docs = len(known), max(1, len(bodies))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) & WORD_MASK | 1 for w in known), U64, n)
    hashes = np.append(hashes, END)
    ids = np.array(words, I64)
    ids[ids < 0] = n
    owner = np.repeat(np.arange(len(bodies)), sizes + (sizes > 0))
    start = np.nonzero(ids != n)[0]
    key = (ids[start] * (n + 1) + ids[start + 1]) * docs + owner[start] if len(start) else start
    del words, ids, owner, start
    key, times = np.unique(key, return_counts=True)
    pair = key // docs
    return hashes, pair // (n + 1), pair % (n + 1), key % docs, times, sizes


def place_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in a sorted table, -1 for those that are not there."""
    if not len(table):
        return np.full(len(values), -1, I64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def packs(batches):
    """Arrow batches (doc_id, body) -> lists of rows and bodies of bounded size."""
    ids, bodies, size = [], [], 0
    for batch in batches:
        for doc_id, x in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id)
            bodies.append(x.as_buffer().to_pybytes())
            size += len(bodies[-1])
            if len(ids) == PACK_DOCS or size >= PACK_BYTES:
                yield ids, bodies
                ids, bodies, size = [], [], 0
    if ids:
        yield ids, bodies


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, U64).view(I64))


class Hot:
    """Exact counts of frequent words and bigrams, and of all tokens."""

    def __init__(self, words, word_counts, pairs, pair_counts, total):
        self.words, self.word_counts = words, word_counts
        self.pairs, self.pair_counts, self.total = pairs, pair_counts, total


def frequent(rows: DataFrame, hot: int = HOT) -> Hot:
    """Two passes: candidates from each pack's own frequent n-grams, then their exact counts.

    An n-gram with a share of 1 / hot of all tokens has at least half of that left after each
    pack has dropped what is below half that share, so no frequent one is missed, and at most
    2 * hot of a kind are taken.
    """
    def counted(bodies):
        hashes, first, second, _, times, sizes = bigrams(bodies)
        n = max(1, len(hashes))
        pair, at = np.unique(first * n + second, return_inverse=True)
        pair_times = np.bincount(at, times).astype(I64) if len(pair) else np.zeros(0, I64)
        word_times = np.bincount(first, times, n).astype(I64)
        a, b = hashes[pair // n], hashes[pair % n]
        real = b != END
        return hashes[:-1], word_times[:-1], a[real], mix(a[real], b[real]), pair_times[real], \
            int(sizes.sum())

    def batch(kind, h, first, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h), kind, np.int32)), _long(h), _long(first),
             pa.array(np.asarray(n, I64))], names=["kind", "h", "first", "n"])

    def candidates(batches):
        for _, bodies in packs(batches):
            words, word_n, first, pairs, pair_n, total = counted(bodies)
            least = max(1, total / (2 * hot))
            w, p = word_n >= least, pair_n >= least
            yield batch(1, words[w], words[w], word_n[w])
            yield batch(2, pairs[p], first[p], pair_n[p])
            yield batch(0, np.zeros(1, U64), np.zeros(1, U64), [total])

    schema = "kind int, h long, first long, n long"
    found = cut(rows.mapInArrow(candidates, schema).groupBy("kind", "h", "first").agg(
        F.sum("n").alias("n")))
    total = found.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    least = max(2.0, total / (2 * hot))
    taken = found.filter((F.col("kind") > 0) & (F.col("n") >= least)).toPandas()
    as_u64 = lambda x: x.to_numpy(I64).view(U64)
    pairs = np.unique(as_u64(taken.loc[taken["kind"] == 2, "h"]))
    words = np.unique(as_u64(taken["first"]))

    def exact(batches):
        word_sum, pair_sum = np.zeros(len(words), I64), np.zeros(len(pairs), I64)
        for _, bodies in packs(batches):
            w, word_n, _, p, pair_n, _ = counted(bodies)
            for table, sums, values, n in ((words, word_sum, w, word_n), (pairs, pair_sum, p, pair_n)):
                at = place_in(table, values)
                np.add.at(sums, at[at >= 0], n[at >= 0])
        yield batch(1, words, words, word_sum)
        yield batch(2, pairs, pairs, pair_sum)

    sums = rows.mapInArrow(exact, schema).groupBy("kind", "h").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for kind in (1, 2):
        part = sums[sums["kind"] == kind]
        h, n = as_u64(part["h"]), part["n"].to_numpy(I64)
        order = np.argsort(h)
        out += [h[order], n[order]]
    return Hot(*out, total)


NAMES = ["kind", "bucket", "uid", "doc", "n_words", "a", "b", "c", "d", "e", "f"]
BINARY = NAMES[5:]
#: Kinds of rows between the steps.
PACK, SUMS, WANTED, TABLE, DOC = range(5)


class Writer:
    """Gathers rows of the steps' common form."""

    def __init__(self, doc_type):
        self.doc_type, self.rows, self.ids = doc_type, [], []

    def add(self, kind, bucket, uid, *data, doc=0, n_words=0, doc_id=None):
        self.rows.append((kind, bucket, uid, doc, n_words,
                          *(np.ascontiguousarray(x).tobytes() for x in data),
                          *[None] * (len(BINARY) - len(data))))
        self.ids.append(doc_id)

    def batch(self):
        cols = list(zip(*self.rows)) if self.rows else [()] * len(NAMES)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 6
        out = pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(self.ids, self.doc_type)],
            names=[*NAMES, "doc_id"])
        self.rows, self.ids = [], []
        return out


class Sums:
    """Partial sums per pack over several buckets of a task, flushed at a bounded size."""

    def __init__(self):
        self.parts: dict[int, np.ndarray] = {}
        self.bytes = 0

    def add(self, uid: int, docs: np.ndarray, values: np.ndarray):
        part = np.bincount(docs, values)
        old = self.parts.get(uid)
        if old is not None:
            if len(old) > len(part):
                part, old = old, part
            else:
                self.bytes += 8 * (len(part) - len(old))
            part[:len(old)] += old
        else:
            self.bytes += 8 * len(part)
        self.parts[uid] = part

    def flush(self, writer: Writer, n_buckets: int, least: int):
        if self.bytes >= least:
            for uid, part in self.parts.items():
                writer.add(SUMS, uid % n_buckets, uid, part)
            self.parts, self.bytes = {}, 0


def _groups(batches, column: str):
    """Rows sorted by a column -> (value, rows as dicts), one value at a time."""
    value, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[column] != value:
                yield value, held
                held = []
            value = row[column]
            held.append(row)
    if held:
        yield value, held


def _read(rows, name, kind):
    return [np.frombuffer(r[name], kind) for r in rows]


def _cat(parts, kind):
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def scores(docs: DataFrame, hot: int = HOT, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, score (mean log2 per bigram, rounded).

    Null texts count as empty; with fewer than two words the score is null. Repeated rows are
    documents of their own, so each counts for the other. Only doc_id and text are read. ``docs``
    should come from stored files, so that a repeated task reads its rows in the same order.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    known = frequent(rows, hot)
    n_buckets = max(1, math.ceil(known.total / bucket_tokens))
    log_total = math.log2(max(1, known.total))
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    schema = ("kind int, bucket long, uid long, doc int, n_words long, "
              + ", ".join(f"{c} binary" for c in BINARY) + f", doc_id {doc_kind}")

    def pack(batches):
        part, writer = TaskContext.get().partitionId(), None
        for number, (ids, bodies) in enumerate(packs(batches)):
            uid = part << 24 | number
            writer = writer or Writer(ids[0].type)
            hashes, first, second, doc, times, sizes = bigrams(bodies)
            for i, (doc_id, n) in enumerate(zip(ids, sizes.tolist())):
                writer.add(DOC, uid % n_buckets, uid, doc=i, n_words=n, doc_id=doc_id.as_py())
            if not len(first):
                yield writer.batch()
                continue
            h1, h2 = hashes[first], hashes[second]
            pair = mix(h1, h2)
            del first, second
            hot_word, hot_pair = place_in(known.words, h1), place_in(known.pairs, pair)
            elsewhere = np.where(hot_pair >= 0, known.pair_counts[hot_pair] - times
                                 if len(known.pairs) else 0, 0)
            here = (elsewhere > 0) & (hot_word >= 0) & (h2 != END)
            value = times[here] * (np.log2(elsewhere[here])
                                   - np.log2(known.word_counts[hot_word[here]]
                                             if len(known.words) else np.ones(0)))
            writer.add(SUMS, uid % n_buckets, uid, np.bincount(doc[here], value, len(ids)))
            away = ~here & ~((hot_word >= 0) & (h2 == END))
            bucket = np.where(hot_word >= 0, pair, h1)[away] % U64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, at = bucket[order], np.nonzero(away)[0][order]
            edges = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=U64))
            for b in np.nonzero(np.diff(edges))[0].tolist():
                own = at[edges[b]:edges[b + 1]]
                f, s = h1[own], h2[own]
                new_f = np.concatenate([[True], f[1:] != f[:-1]])
                new_p = new_f | np.concatenate([[True], s[1:] != s[:-1]])
                pairs_at = np.nonzero(new_p)[0]
                firsts_at = np.nonzero(new_f[pairs_at])[0]
                count = lambda starts, n: np.diff(np.append(starts, n)).astype(np.uint32)
                writer.add(PACK, b, uid, thin(f[pairs_at][firsts_at]), count(firsts_at, len(pairs_at)),
                           thin(s[pairs_at]), count(pairs_at, len(own)), doc[own].astype(np.uint16),
                           times[own].astype(np.uint32))
            yield writer.batch()
        if writer and writer.rows:
            yield writer.batch()

    def forward(writer, row):
        writer.add(row["kind"], row["bucket"], row["uid"], np.frombuffer(row["a"] or b"", np.uint8),
                   doc=row["doc"], n_words=row["n_words"], doc_id=row["doc_id"])

    def join(batches):
        doc_type = None

        def typed():
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field("doc_id").type
                yield batch

        sums = Sums()
        for bucket, group in _groups(typed(), "bucket"):
            writer = Writer(doc_type)
            for row in group:
                if row["kind"] != PACK:
                    forward(writer, row)
            mine = [r for r in group if r["kind"] == PACK]
            if mine:
                _count(writer, sums, bucket, mine)
            sums.flush(writer, n_buckets, SUM_BYTES)
            yield writer.batch()
        if sums.parts:
            writer = Writer(doc_type)
            sums.flush(writer, n_buckets, 0)
            yield writer.batch()

    def _count(writer, sums, bucket, mine):
        w1, n1 = [wide(r["a"]) for r in mine], _read(mine, "b", np.uint32)
        w2, n2 = [wide(r["c"]) for r in mine], _read(mine, "d", np.uint32)
        doc = _cat(_read(mine, "e", np.uint16), np.uint16).astype(I64)
        times = _cat(_read(mine, "f", np.uint32), np.uint32).astype(I64)
        owner = np.repeat(np.arange(len(mine)), [int(x.sum()) for x in n2])
        first = np.repeat(_cat(w1, U64), _cat(n1, np.uint32))
        second, docs_of = _cat(w2, U64), _cat(n2, np.uint32).astype(I64)
        starts = np.concatenate([[0], np.cumsum(docs_of)[:-1]])
        pair_times = np.add.reduceat(times, starts)
        _, at = np.unique(mix(first, second), return_inverse=True)
        total = np.bincount(at, pair_times).astype(I64)[at]
        words, word_at = np.unique(first, return_inverse=True)
        word_n = np.bincount(word_at, pair_times).astype(I64)
        hot_at = place_in(known.words, words)
        if len(known.words):
            word_n = np.where(hot_at >= 0, known.word_counts[hot_at], word_n)
        writer.add(TABLE, bucket, 0, thin(words[hot_at < 0]), word_n[hot_at < 0])
        entry = np.repeat(np.arange(len(second)), docs_of)
        elsewhere = total[entry] - times
        real = second[entry] != END
        value = np.zeros(len(entry))
        found = real & (elsewhere > 0)
        value[found] = times[found] * (np.log2(elsewhere[found])
                                       - np.log2(word_n[word_at[entry[found]]]))
        alone = np.nonzero(real & ~found)[0]
        hot_at = place_in(known.words, second[entry[alone]])
        easy = alone[hot_at >= 0]
        if len(easy):
            value[easy] = times[easy] * (math.log2(ALPHA) - log_total
                                         + np.log2(known.word_counts[hot_at[hot_at >= 0]]))
        ends = np.concatenate([[0], np.cumsum([int(x.sum()) for x in n2])])
        for i, row in enumerate(mine):
            own = slice(ends[i], ends[i + 1])
            sums.add(row["uid"], doc[own], value[own])
        rest = alone[hot_at < 0]
        wanted = second[entry[rest]]
        order = np.lexsort((wanted, wanted % U64(n_buckets)))
        rest, wanted = rest[order], wanted[order]
        edges = np.searchsorted(wanted % U64(n_buckets), np.arange(n_buckets + 1, dtype=U64))
        uids = np.array([r["uid"] for r in mine], I64)
        for b in np.nonzero(np.diff(edges))[0].tolist():
            own, w = rest[edges[b]:edges[b + 1]], wanted[edges[b]:edges[b + 1]]
            starts = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
            here, small = np.unique(owner[own], return_inverse=True)
            writer.add(WANTED, b, 0, thin(w[starts]), np.diff(np.append(starts, len(w))).astype(np.uint32),
                       uids[here], small.astype(np.uint32), doc[own].astype(np.uint16),
                       times[own].astype(np.uint32))

    def back_off(batches):
        doc_type = None

        def typed():
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field("doc_id").type
                yield batch

        sums = Sums()
        for _, group in _groups(typed(), "bucket"):
            writer = Writer(doc_type)
            tables = [r for r in group if r["kind"] == TABLE]
            words = _cat([wide(r["a"]) for r in tables], U64)
            counts = _cat(_read(tables, "b", I64), I64)
            order = np.argsort(words)
            words, counts = words[order], counts[order]
            for row in group:
                if row["kind"] in (SUMS, DOC):
                    forward(writer, row)
                elif row["kind"] == WANTED:
                    n, uids, owner, doc, times = (np.frombuffer(row[c], k) for c, k in zip(
                        BINARY[1:], (np.uint32, I64, np.uint32, np.uint16, np.uint32)))
                    c = np.repeat(counts[np.searchsorted(words, wide(row["a"]))], n)
                    value = times * (math.log2(ALPHA) - log_total + np.log2(c))
                    for i, uid in enumerate(uids.tolist()):
                        own = owner == i
                        sums.add(uid, doc[own].astype(I64), value[own])
            sums.flush(writer, n_buckets, SUM_BYTES)
            yield writer.batch()
        if sums.parts:
            writer = Writer(doc_type)
            sums.flush(writer, n_buckets, 0)
            yield writer.batch()

    def add_up(batches):
        doc_type = None

        def typed():
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field("doc_id").type
                yield batch

        for _, group in _groups(typed(), "uid"):
            docs_of = sorted((r for r in group if r["kind"] == DOC), key=lambda r: r["doc"])
            sums = np.zeros(len(docs_of))
            for row in group:
                if row["kind"] == SUMS:
                    part = np.frombuffer(row["a"], np.float64)
                    sums[:len(part)] += part
            n = [r["n_words"] for r in docs_of]
            mean = [round(s / (k - 1), DECIMALS) if k > 1 else None for s, k in zip(sums.tolist(), n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in docs_of], doc_type), pa.array(n, pa.int64()),
                 pa.array(mean, pa.float64())], names=["doc_id", "n_words", "score"])

    dealt = lambda df, by: df.repartition(by).sortWithinPartitions(by)
    counted = dealt(rows.mapInArrow(pack, schema), "bucket").mapInArrow(join, schema)
    backed = dealt(counted, "bucket").mapInArrow(back_off, schema)
    return dealt(backed, "uid").mapInArrow(add_up, f"doc_id {doc_kind}, n_words long, score double")
