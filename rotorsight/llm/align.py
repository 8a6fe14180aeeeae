"""Alignment of two tokenizers over a corpus: groups, links and how usual each linked pair is.

Texts become Arrow columns and stay there. Tokens of both sides end before a single space between
two visible characters, so texts are cut there into pieces; a piece that occurs again is encoded
and aligned only once in a task. Their id lists are flattened, the parent indices say whose tokens they are, a
cumulative sum per segment gives the byte at which each token ends, and a hash join of both sides
on (piece, end) finds where both end: the groups. Every end of either side closes the overlap of
one pair of tokens: the links. ``Table.group_by`` counts links per document and pair, then per
task and pair; Spark merges these partial counts over the corpus.

Counts return to the documents in two ways, both always taken: pairs that hold more than
``FREQUENT`` of all links are below 1 / FREQUENT in number and travel to every task; the others
are joined by Spark, where no key holds more than that share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Share of all links above which a pair is frequent.
FREQUENT = 2.0 ** -17
#: Bytes of pieces encoded at once; pieces whose links are counted at once; different pieces and
#: pairs that a task keeps in memory.
ENCODE_BYTES = 1 << 18
PIECES = 1 << 19
KNOWN = 3 << 17
PAIRS = 1 << 19

ROW = ("doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "a array<int>, b array<int>, n array<long>")


class Tokenizers:
    """Both vocabularies and the bytes that each token stands for."""

    def __init__(self, byte_file: str, piece_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        place = {c: b for b, c in enumerate(_byte_letters())}
        entries = self.first.get_vocab(with_added_tokens=False)
        self.first_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.first_bytes[i] = bytes(place[c] for c in entry)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i)
                             else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Cutting at spaces is exact as long as no piece runs over a space.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Texts that begin with a space -> ids of both sides (the second adds that space)."""
        a = [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]
        return a, self.second.encode([t[1:] for t in texts], num_threads=1)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, other = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], other = chr(other), other + 1
    return letters


def split(texts: pa.Array, cuts: bool = True) -> tuple[pa.Array, pa.Array]:
    """Texts -> pieces of space + text, each with a space in front, and the parent of each."""
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(none, texts.cast(pa.large_string()), space)
    if not cuts:
        return spaced, pa.array(np.arange(len(spaced)))
    raw, offsets = _data(spaced)
    # Neighbours of the space: printable ASCII, or letters and the like from U+00C0 to U+07FF.
    shown, wide = (raw > 0x20) & (raw < 0x7F), (raw >= 0xC3) & (raw <= 0xDF)
    before = shown[1:-2] | wide[:-3]
    inner = np.nonzero((raw[2:-1] == 0x20) & before & (shown | wide)[3:])[0] + 2
    # A text begins with a space of its own, which may look like one of these.
    new = np.zeros(len(raw) + 1, bool)
    new[inner] = new[offsets] = True
    ends = np.nonzero(new)[0]
    starts = ends[:-1]
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw))
    return pieces, pa.array(np.searchsorted(offsets, starts, "right") - 1)


def _lists(values: list) -> pa.LargeListArray:
    return pa.array(values, pa.large_list(pa.int32()))


def _segment_ends(lengths: pa.Array, parents: pa.Array, n_parents: int) -> pa.Array:
    """Cumulative sum of ``lengths`` that begins anew at each parent."""
    running = pc.cumulative_sum(lengths).to_numpy(zero_copy_only=False)
    parent = parents.to_numpy(zero_copy_only=False)
    base = np.zeros(n_parents, np.int64)
    head = np.nonzero(np.diff(parent, prepend=-1))[0]
    base[parent[head]] = running[head] - lengths.to_numpy(zero_copy_only=False)[head]
    return pa.array(running - base[parent])


def _tokens(ids: pa.LargeListArray, sizes: pa.Array, side: str) -> pa.Table:
    """One row per token: key of (piece, end), its id and its own number, named after ``side``."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    ends = _segment_ends(sizes.take(flat), parents, len(ids))
    key = pc.add(pc.multiply(parents.cast(pa.int64()), 1 << 32), ends)
    return pa.table({"key": key, side: flat, f"at_{side}": pa.array(np.arange(len(flat)))})


def _joined_ids(ids: pa.Array, group: np.ndarray, n_groups: int) -> pa.Array:
    """Decimal ids of each group, joined by commas; ``group`` rises."""
    offsets = np.searchsorted(group, np.arange(n_groups + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(offsets, ids.cast(pa.string())), ",")


def align(ids_a: pa.LargeListArray, ids_b: pa.LargeListArray, sizes_a: pa.Array,
          sizes_b: pa.Array) -> pa.Table:
    """Per piece its numbers of tokens, groups and links, the groups as text and the links.

    Columns n_a, n_b, n_groups, groups, links (list of a * 2^32 + b). Both sides of a piece must
    stand for the same bytes; no token stands for none.
    """
    n = len(ids_a)
    a, b = _tokens(ids_a, sizes_a, "a"), _tokens(ids_b, sizes_b, "b")
    both = a.join(b, "key", join_type="inner", use_threads=False)
    shared = np.sort(both["key"].to_numpy())
    group_at = np.searchsorted(shared, np.arange(n + 1, dtype=np.int64) << 32, "right")
    text = [_joined_ids(t[side].combine_chunks(), np.searchsorted(shared, t["key"].to_numpy()),
                        len(shared)) for t, side in ((a, "a"), (b, "b"))]
    groups = pc.binary_join(pa.ListArray.from_arrays(
        group_at.astype(np.int32), pc.binary_join_element_wise(*text, "|")), ";")
    # Every end of either side closes one overlap; the token there, or the next one to end.
    every = a.join(b, "key", join_type="full outer", coalesce_keys=True, use_threads=False)
    every = every.take(pc.sort_indices(every["key"]))
    pair = [pc.fill_null_backward(every[side]).cast(pa.int64()).combine_chunks() for side in "ab"]
    codes = pc.add(pc.multiply(pair[0], 1 << 32), pair[1])
    link_at = np.searchsorted(every["key"].to_numpy(), np.arange(n + 1, dtype=np.int64) << 32,
                              "right")
    return pa.table({
        "n_a": pc.list_value_length(ids_a), "n_b": pc.list_value_length(ids_b),
        "n_groups": pa.array(np.diff(group_at)), "groups": groups,
        "links": pa.LargeListArray.from_arrays(link_at.astype(np.int64), codes)})


def _spans(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most ``most``, or of one."""
    if not len(sizes):
        return []
    block = np.cumsum(sizes) // most
    heads = np.nonzero(np.diff(block, prepend=-1))[0].tolist()
    return list(zip(heads, [*heads[1:], len(sizes)]))


def _data(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large string or binary array, and where each value begins and ends."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    return np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _same_bytes(pieces: pa.Array, ids: pa.LargeListArray, entries: pa.Array) -> np.ndarray:
    """Which pieces their tokens give again."""
    want, ends = _data(pieces)
    got, token_ends = _data(entries.take(pc.list_flatten(ids)))
    got_ends = token_ends[ids.offsets.to_numpy()]
    if np.array_equal(ends, got_ends) and np.array_equal(want, got):
        return np.ones(len(pieces), bool)
    return np.fromiter((np.array_equal(want[ends[i]:ends[i + 1]], got[got_ends[i]:got_ends[i + 1]])
                        for i in range(len(pieces))), bool, len(pieces))


def aligned_pieces(pieces: pa.Array, tokens: Tokenizers) -> pa.Table:
    """``align`` of different pieces, with ok: both sides give the bytes of the piece again."""
    entries = [pa.array(t, pa.large_binary()) for t in (tokens.first_bytes, tokens.second_bytes)]
    sizes = [pc.binary_length(t) for t in entries]
    parts = []
    for lo, hi in _spans(pc.binary_length(pieces).to_numpy(zero_copy_only=False), ENCODE_BYTES):
        some = pieces.slice(lo, hi - lo)
        ids = [_lists(x) for x in tokens.encode(some.to_pylist())]
        ok = np.logical_and(*(_same_bytes(some, i, t) for i, t in zip(ids, entries)))
        if not ok.all():
            ids = [pc.if_else(pa.array(ok), i, pa.scalar([], i.type)) for i in ids]
        parts.append(align(*ids, *sizes).append_column("ok", pa.array(ok)))
    return pa.concat_tables(parts).combine_chunks()


class Known:
    """Pieces that the task has aligned so far, at most ``KNOWN`` beside those of one batch."""

    def __init__(self, tokens: Tokenizers):
        self.tokens, self.pieces, self.table, self.groups = tokens, None, None, []

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """Different pieces -> their rows in ``table`` and ``groups``."""
        if self.pieces is not None and len(self.pieces) > KNOWN:
            self.pieces = None
        if self.pieces is None:
            self.pieces, self.table = pieces, aligned_pieces(pieces, self.tokens)
            self.groups = [x.encode() for x in self.table["groups"].to_pylist()]
            return np.arange(len(pieces))
        new = pieces.filter(pc.is_null(pc.index_in(pieces, self.pieces)))
        if len(new):
            found = aligned_pieces(new, self.tokens)
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.table = pa.concat_tables([self.table, found]).combine_chunks()
            self.groups += [x.encode() for x in found["groups"].to_pylist()]
        return pc.index_in(pieces, self.pieces).to_numpy()


def _pairs(owner: np.ndarray, kinds: np.ndarray, links: pa.LargeListArray) -> pa.Table:
    """Documents and their pieces -> (doc, pair, n): links per document and pair, doc rising."""
    parts = []
    for lo in range(0, len(kinds), PIECES):
        held = links.take(pa.array(kinds[lo:lo + PIECES]))
        doc = pa.array(owner[lo:lo + PIECES]).take(pc.list_parent_indices(held))
        parts.append(pa.table({"doc": doc, "pair": pc.list_flatten(held)}).group_by(
            ["doc", "pair"], use_threads=False).aggregate([([], "count_all")]))
    found = pa.concat_tables(parts).rename_columns(["doc", "pair", "n"])
    if len(parts) > 1:
        found = found.group_by(["doc", "pair"], use_threads=False).aggregate(
            [("n", "sum")]).rename_columns(["doc", "pair", "n"])
    return found.take(pc.sort_indices(found["doc"]))


def measured(doc_id: pa.Array, texts: pa.Array, known: Known) -> list[pa.Array]:
    """The columns of ``ROW`` for some documents."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    full = np.nonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)[0]
    numbers = np.zeros((4, n), np.int64)
    digests = [""] * n
    pair, count, offsets = pa.array([], pa.int64()), pa.array([], pa.int64()), np.zeros(n + 1, int)
    if len(full):
        pieces, parents = split(texts.take(pa.array(full)), known.tokens.cuts)
        owner = full[parents.to_numpy()]
        coded = pieces.dictionary_encode()
        kinds = known.rows(coded.dictionary)[coded.indices.to_numpy()]
        found = known.table
        # Tokens never stand for more bytes than they cover: one bad piece spoils its document.
        bad = np.zeros(n, bool)
        bad[owner[~found["ok"].to_numpy()[kinds]]] = True
        kinds, owner = kinds[~bad[owner]], owner[~bad[owner]]
        link_lists = found["links"].combine_chunks()
        for row, values in zip(numbers, (found["n_a"], found["n_b"], found["n_groups"],
                                         pc.list_value_length(link_lists))):
            np.add.at(row, owner, values.to_numpy()[kinds])
        at = np.searchsorted(owner, np.arange(n + 1))
        for i in np.unique(owner).tolist():
            digest = hashlib.sha256()
            for lo in range(at[i], at[i + 1], PIECES):
                part = kinds[lo:min(lo + PIECES, at[i + 1])].tolist()
                digest.update((b";" if lo > at[i] else b"") + b";".join([known.groups[k] for k in part]))
            digests[i] = digest.hexdigest()
        if len(kinds):
            pairs = _pairs(owner, kinds, link_lists)
            pair, count = pairs["pair"].combine_chunks(), pairs["n"].combine_chunks()
            offsets = np.searchsorted(pairs["doc"].to_numpy(), np.arange(n + 1))
    offsets = pa.array(offsets, pa.int32())
    lists = [pc.shift_right(pair, 32).cast(pa.int32()),
             pc.bit_wise_and(pair, (1 << 32) - 1).cast(pa.int32()), count.cast(pa.int64())]
    return [doc_id, *map(pa.array, numbers), pa.array(digests),
            *(pa.ListArray.from_arrays(offsets, x) for x in lists)]


def aligned(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """One row per row of ``docs`` with its own numbers and its linked id pairs (a, b, n)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches):
        known = Known(Tokenizers(byte_file, piece_file))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(measured(*batch.columns, known), names=names)

    return docs.select("doc_id", "text").mapInArrow(run, ROW.format(kind=kind))


def _partial_counts(batches):
    """Lists (a, b, n) -> rows (a, b, n), added up over the batches of the task."""
    def merged(tables):
        return pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate(
            [("n", "sum")]).rename_columns(["a", "b", "n"]).combine_chunks()

    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.table([pc.list_flatten(c) for c in batch.columns], names=["a", "b", "n"]))
        rows += held[-1].num_rows
        if rows > PAIRS:
            held = [merged(held)]
            rows = held[0].num_rows
            if rows > PAIRS // 2:
                yield from held.pop().to_batches()
                rows = 0
    if held:
        yield from merged(held).to_batches()


def pair_counts(rows: DataFrame) -> DataFrame:
    """Corpus counts: a, b, n, and best (no a is linked with this b more often; ties are best).

    The highest count per b has at most as many rows as the second vocabulary.
    """
    counts = cut(rows.select("a", "b", "n").mapInArrow(
        _partial_counts, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = cut(counts.groupBy("b").agg(F.max("n").alias("most")))
    return cut(counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def _weigh(frequent: pa.Table):
    """Batches (row, a, b, n) -> per row the sums over frequent pairs, and its other pairs."""
    def run(batches):
        for batch in batches:
            lists = batch.columns[1:]
            parents = pc.list_parent_indices(lists[0])
            flat = pa.table([parents, *(pc.list_flatten(c) for c in lists)],
                            names=["doc", "a", "b", "n"])
            met = flat.join(frequent, ["a", "b"], join_type="left outer", use_threads=False)
            known = met.filter(pc.is_valid(met["total"]))
            sums = pa.table({
                "doc": known["doc"], "n_best": pc.multiply(known["n"], known["best"]),
                "count_sum": pc.multiply(known["n"], known["total"])}).group_by(
                "doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
            out = np.zeros((2, len(batch)), np.int64)
            for row, name in zip(out, ("n_best_sum", "count_sum_sum")):
                row[sums["doc"].to_numpy()] = sums[name].to_numpy()
            rest = met.filter(pc.is_null(met["total"])).sort_by("doc")
            offsets = pa.array(np.searchsorted(rest["doc"].to_numpy(), np.arange(len(batch) + 1)),
                               pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, out),
                 *(pa.ListArray.from_arrays(offsets, rest[c].combine_chunks()) for c in "abn")],
                names=["row", "n_best", "count_sum", "a", "b", "n"])
    return run


def alignment(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    The first tokenizer sees a space and the text, the second the text (it adds that space). Null
    and empty texts and those whose tokens of either side do not give their bytes again have no
    tokens: zeros and an empty string; nor do they count in the corpus. Rows that repeat count as
    often as they occur. A long text is encoded in pieces; only a stretch without any space
    between printable ASCII characters is encoded as one. An empty table gives an empty result;
    other columns are not read.
    """
    rows = cut(aligned(docs, byte_file, piece_file).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(rows)
    links = rows.agg(F.sum("n_links")).first()[0] or 0
    # Fewer than 1 / FREQUENT rows, whatever the corpus.
    frequent = counts.filter(F.col("n") > links * FREQUENT).select(
        "a", "b", F.col("n").alias("total"), F.col("best").cast("long").alias("best")).toArrow()
    weighed = cut(rows.select("row", "a", "b", "n").mapInArrow(
        _weigh(frequent), "row long, n_best long, count_sum long, a array<int>, b array<int>, "
                          "n array<long>"))
    rest = weighed.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select(
        "row", "x.a", "x.b", F.col("x.n").alias("links")).join(counts, ["a", "b"])
    sums = weighed.select("row", "n_best", "count_sum").union(rest.select(
        "row", F.when(F.col("best"), F.col("links")).otherwise(0), F.col("links") * F.col("n"))
        ).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                         "count_sum", "groups_sha256")
