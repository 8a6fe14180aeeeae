"""Exact deduplication against brute force, chunk arithmetic, collisions."""

import hashlib
import random
import re

from rotorsight.llm import exact_dedup as X


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    out = []
    for i, (doc_id, text) in enumerate(rows):
        group = [(-len(t or ""), d is None, d or 0, j) for j, (d, t) in enumerate(rows)
                 if norm(t) == norm(text)]
        best = min(group)[3]
        out.append((doc_id, rows[best][0], len(group), i == best,
                    hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(1)
    rows = [(None, None), (1, ""), (2, " \n\t\x0b"), (3, "é a"), (4, "éa"), (5, "é\ta\r"), (6, "É a"),
            (7, "x" * 200000), (8, "x" * 199999 + " x"), (9, "x" * 199999 + "y"), (10, "a\u00a0b"),
            (10, "ab"), (None, "éa")]
    rows += [(20, "same row")] * 3
    rows += [(i, " " * rng.randint(0, 3) + "copy of many") for i in range(30, 60)]
    return rows


def test_equals_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(X, "GROUP_SLICE", 4)
    got = X.exact_duplicates(make_docs(some_rows())).drop("k1", "k2").collect()
    assert sorted(map(tuple, got), key=str) == brute(some_rows())


def test_keep_one_returns_whole_rows(spark, make_docs):
    docs = make_docs(some_rows())
    kept = X.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in brute(some_rows()))
    assert X.keep_one(docs.limit(0)).count() == 0


def test_chunk_hashes_combine():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(3 * X.CHUNK + 17))
    whole = X.fingerprint(data)
    value = tuple(0 for _ in X.PRIMES)
    for byte in data:
        value = tuple((v * b + byte + 1) % p for v, b, p in zip(value, X.BASES, X.PRIMES))
    assert whole == value
    for at in (0, 1, 1000, X.CHUNK, len(data) - 1):
        left, right = data[:at], data[at:]
        assert X.combine(X.fingerprint(left), X.fingerprint(right), len(right)) == whole


def test_chunks_of_one_text_are_hashed_by_many_tasks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 1 << 10)
    monkeypatch.setattr(X, "_POWERS", [])
    rng = random.Random(4)
    text = "".join(rng.choices("ab é\n\t漢", k=100000))
    rows = [(1, text), (1, text), (2, text.replace(" ", "")), (3, text + "x"), (4, " " * 5000),
            (5, None), (6, "short")]
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "").encode()
    got = X.fingerprints(make_docs(rows)).collect()
    want = [(d, len(t or ""), len(norm(t)), *X.fingerprint(norm(t)),
             hashlib.sha256(norm(t)).hexdigest()) for d, t in rows]
    assert sorted((r["doc_id"], r["n_points"], r["n_bytes"], r["f1"], r["f2"], r["text_sha256"])
                  for r in got) == sorted(want)
    duplicates = X.exact_duplicates(make_docs(rows)).drop("k1", "k2").collect()
    assert sorted(map(tuple, duplicates), key=str) == brute(rows)


def test_collisions_do_not_merge(spark, make_docs, monkeypatch):
    """With a fingerprint that sees the length only, texts of one length are still told apart."""
    monkeypatch.setattr(X, "fingerprint", lambda data: (0, 0))
    monkeypatch.setattr(X, "CHUNK", 8)
    rows = [(1, "abcdefghijk"), (2, "abcdefghijK"), (3, "abcdefgh ijk"), (4, "zbcdefghijk"),
            (5, "z bcdefghijk"), (6, "abcdefghijk")]
    got = X.exact_duplicates(make_docs(rows)).drop("k1", "k2").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
