"""Chunked encoding against the library on whole texts; round trips."""

import random

import pytest

from rotorsight.llm import bpe
from rotorsight.llm.queries import tokenizer

public = pytest.importorskip("public_tokenizers")


def some_rows():
    rng = random.Random(1)
    parts = ["It's", " we'll", "'", "’", "\n", "\n\n", "   ", "\t", " 12", "3.5", "é", "日本語", "\u2003",
             " word", "x", "!!", "<|endoftext|>", "\x1c", "a"]
    text = lambda n: "".join(rng.choices(parts, k=n))
    return [(None, None), (1, ""), (2, " "), (3, "<|endoftext|>"), (4, "a" * 3000), (5, " " * 3000),
            (6, "日本語" * 900), (6, "日本語" * 900)] + [(i, text(rng.choice([3, 100, 900, 3000])))
                                                  for i in range(10, 50)]


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (200, 40), (64, 12)])
def test_equals_the_library(spark, make_docs, monkeypatch, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    ranks, pattern = tokenizer()
    codec = bpe.Codec(ranks, pattern)
    want = sorted(((d, codec.encode(t or "").tolist(), (t or "").encode()) for d, t in some_rows()), key=str)
    encoded = bpe.encode(make_docs(some_rows()), ranks, pattern)
    got = bpe.decode(encoded, ranks, pattern).select("doc_id", "ids", "body").collect()
    assert sorted(((r[0], r[1], bytes(r[2])) for r in got), key=str) == want


def test_long_prose_is_stitched_not_joined(spark, make_docs):
    ranks, pattern = tokenizer()
    codec = bpe.Codec(ranks, pattern)
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdé'", k=rng.randint(1, 8))) for _ in range(40000))
    row = bpe.encode(make_docs([(1, text)]), ranks, pattern).first()
    assert row["ids"] == codec.encode(text).tolist()


def test_a_lost_seam_joins_two_chunks_only(spark, make_docs, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 400)
    monkeypatch.setattr(bpe, "OVERLAP", 60)
    ranks, pattern = tokenizer()
    codec = bpe.Codec(ranks, pattern)
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 8))) for _ in range(n))
    cjk = "".join(rng.choices("日本語漢字かなカナ，。、！한국", k=6000))
    rows = [(1, prose(300) + " " + "a" * 1000 + " " + prose(300)), (2, cjk), (3, "語" * 5000)]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(make_docs(rows), ranks, pattern).collect()}
    assert got == {d: codec.encode(t).tolist() for d, t in rows}
    chunks = spark.createDataFrame(
        [(str(d), 0, i, (len(t) - 61) // 400, t[i * 400:i * 400 + 460] if i < (len(t) - 61) // 400
          else t[i * 400:]) for d, t in rows for i in range((len(t) - 61) // 400 + 1)],
        "k1 string, k2 long, no int, last int, chunk string")
    pieces = bpe.stitched(chunks, ranks, pattern).collect()
    size = {d: [len(r["text"]) for r in pieces if r["k1"] == str(d)] for d, _ in rows}
    assert all(sum(size[d]) == len(t) for d, t in rows)
    assert len(size[1]) >= 5 and max(size[1]) < 2500
    assert len(size[2]) >= 12 and size[3] == [5000]


def test_empty_table(spark, make_docs):
    ranks, pattern = tokenizer()
    assert bpe.encode(make_docs([]).limit(0), ranks, pattern).count() == 0
