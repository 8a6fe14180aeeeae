"""Byte-level BPE encoding and decoding over overlapping chunks.

A text is cut into chunks of ``CHUNK`` code points, each followed by ``OVERLAP`` more that belong
to the next one. Chunks are split into pre-tokens on their own, in parallel. Where a chunk and
its successor find the same boundary in the overlap, the two splits have resynchronised: up to
there the first one counts, from there on the second. The pieces between such places are
encoded one by one. If an overlap has no common boundary (a single pre-token may span it), the
two chunks at that seam stay in one piece. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import id_text, text_hash

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Characters whose classes are the same in every Unicode version that has them: printable ASCII,
#: Latin-1 letters, kana, Chinese characters, Hangul, their punctuation and full-width signs.
STABLE = ("!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u3001-\u3003\u3008-\u3011\u3041-\u3094"
          "\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e")
#: Code points before the end of a chunk where a split may still depend on what follows.
UNSURE = 4


class Codec:
    """A rank file and a pre-token pattern; made in the task that uses it."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                         special_tokens={})
        self.pattern = regex.compile(pattern)
        self.stable = regex.compile(f"[{STABLE}]")
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def boundaries(self, text: str) -> list[int]:
        """Ends of pre-tokens between two ``STABLE`` characters; the second may be white space.

        A token of white space may depend on what follows, so its end is not used; other
        characters are left out because pattern libraries differ in their Unicode versions.
        """
        ends = (m.end() for m in self.pattern.finditer(text))
        return [e for e in ends if e < len(text) and self.stable.match(text[e - 1])
                and (text[e] in " \n" or self.stable.match(text[e]))]

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoder.encode_to_numpy(text, disallowed_special=()), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def _encode_rows(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The column text becomes ids."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        codec = Codec(ranks_path, pattern)
        for batch in batches:
            ids = [codec.encode(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=[*batch.schema.names[:-1], "ids"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return rows.select(*(f.name for f in others), "text").mapInArrow(
        run, f"{schema}, ids array<int>")


def _boundaries(chunks: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds head and tail: boundaries in the first and last ``OVERLAP`` code points."""
    def run(batches):
        codec = Codec(ranks_path, pattern)
        for batch in batches:
            head, tail = [], []
            for x in batch.column(batch.schema.get_field_index("chunk")):
                found = codec.boundaries(x.as_py())
                head.append([e for e in found if e <= OVERLAP - UNSURE])
                tail.append([e - CHUNK for e in found if 0 < e - CHUNK <= OVERLAP - UNSURE])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(head, kind), pa.array(tail, kind)],
                names=[*batch.schema.names, "head", "tail"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{schema}, head array<int>, tail array<int>")


def stitched(chunks: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Chunk rows (k1, k2, no, last, chunk) -> pieces (k1, k2, no, text) that encode alone.

    ``chunk`` of all but the last holds the overlap too. The seam search is a lead over the
    chunks of one text, which are few and hold no other text. A chunk without a seam to the next
    one gives all its own code points to the piece that the next one goes on with.
    """
    of_text = Window.partitionBy("k1", "k2").orderBy("no")
    seams = _boundaries(chunks, ranks_path, pattern).withColumn(
        "seam", F.when(F.col("no") < F.col("last"), F.array_min(F.array_intersect(
            "tail", F.lead("head").over(of_text)))))
    seams = seams.withColumns({
        "begin": F.coalesce(F.lag("seam").over(of_text), F.lit(0)),
        "piece": F.count("seam").over(of_text.rowsBetween(Window.unboundedPreceding, -1))})
    end = F.when(F.col("no") < F.col("last"), CHUNK + F.coalesce("seam", F.lit(0))).otherwise(
        F.char_length("chunk"))
    parts = seams.select("k1", "k2", F.col("piece").cast("int").alias("piece"), F.struct(
        "no", F.substring("chunk", F.col("begin") + 1, end - F.col("begin")).alias("text")).alias("p"))
    return parts.groupBy("k1", "k2", "piece").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("p")), lambda x: x["text"]), "").alias("text")).select(
        "k1", "k2", F.col("piece").alias("no"), "text")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, k1, k2, ids (array of int).

    ``ranks_path`` is a file that every worker has (part of an installed package). Null texts
    count as empty and have no ids. Special tokens are ordinary text. Texts of one chunk are
    encoded where they are read; the chunks of longer ones are dealt out to other tasks. An
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select("doc_id", id_text().alias("k1"), text_hash().alias("k2"),
                       F.coalesce("text", F.lit("")).alias("text"))
    one = F.char_length("text") <= CHUNK + OVERLAP
    short = _encode_rows(rows.filter(one), ranks_path, pattern)
    last = F.expr(f"cast((char_length(text) - {OVERLAP} - 1) div {CHUNK} as int)")
    chunks = rows.filter(~one).select("k1", "k2", "text", last.alias("last")).select(
        "k1", "k2", "text", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("no"))
    chunks = chunks.select("k1", "k2", "no", "last", F.substring(
        "text", F.col("no") * CHUNK + 1,
        F.when(F.col("no") < F.col("last"), CHUNK + OVERLAP).otherwise(F.lit(2 ** 31 - 1)))
        .alias("chunk")).dropDuplicates(["k1", "k2", "no"])
    pieces = stitched(chunks, ranks_path, pattern)
    ids = _encode_rows(pieces, ranks_path, pattern).groupBy("k1", "k2").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    long = rows.filter(~one).select("doc_id", "k1", "k2").join(ids, ["k1", "k2"])
    return short.union(long.select("doc_id", "k1", "k2", "ids"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, k1, k2, ids) with the column ``body``: the decoded bytes.

    Null ids count as none; an id outside the rank file fails the job.
    """
    def run(batches):
        codec = Codec(ranks_path, pattern)
        for batch in batches:
            bodies = [codec.decode(x.as_py() or []) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bodies, pa.binary())], names=[*batch.schema.names, "body"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "k1", "k2", "ids").mapInArrow(
        run, f"doc_id {kind}, k1 string, k2 long, ids array<int>, body binary")
