"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from rotorsight.llm import suffix_dedup as S


def brute(rows, length=S.LENGTH):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def rows_of(seed):
    rng = random.Random(seed)
    shared = [words(rng, 90) for _ in range(4)] + [words(rng, 300)]
    exact = words(rng, 200)[:S.LENGTH]
    rows = [(None, None), (1, ""), (2, "short"), (3, "a" * 1500), (4, "ab" * 700), (5, words(rng, 400))]
    rows += [(3, "a" * 1500), (7, rows[5][1]), (8, exact), (9, "x" + exact + "y")]
    for i in range(10, 40):
        parts = [words(rng, rng.randint(0, 60)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 60):])
        rows.append((i, " ".join(parts)))
    long = words(rng, 3000)
    rows += [(50, long), (51, long[:5000] + "#" + long[5001:9000] + long[2000:2600]), (52, long[::-1])]
    return rows


def check(spark, make_docs, rows):
    got = S.remove_repeats(make_docs(rows)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_equals_brute_force(spark, make_docs):
    check(spark, make_docs, rows_of(1))


@pytest.mark.parametrize("width", [1, 7, 200])
def test_any_width_of_bands(spark, make_docs, monkeypatch, width):
    monkeypatch.setattr(S, "WIDTH", width)
    check(spark, make_docs, rows_of(2))


def test_many_phrases_of_one_seed(spark, make_docs):
    """Neighbours at every distance of one passage: equal, longer, shorter and broken ones."""
    rng = random.Random(5)
    passage = words(rng, 200)[:700]
    rows = []
    for i in range(320):
        a, b = rng.randint(0, 300), rng.randint(400, 700)
        text = passage[a:b]
        if i % 5 == 0:
            text = text[:len(text) // 2] + "#" + text[len(text) // 2:]
        rows.append((i, words(rng, 20) + text + words(rng, 20)))
    check(spark, make_docs, rows)


def test_passages_of_fifty_words_by_their_length(spark, make_docs):
    """Fifty words over 400 bytes leave all their documents, fifty shorter words stay."""
    rng = random.Random(6)
    pick = lambda n, a, b: " ".join(
        "".join(rng.choice("abcdefgh") for _ in range(rng.randint(a, b))) for _ in range(n))
    long, short = pick(52, 8, 12), pick(52, 3, 5)
    assert len(long) >= S.LENGTH > len(short) + 4
    rows = [(i, pick(30, 3, 9) + f"\n{(long, short)[i % 2]}\n" + pick(30, 3, 9)) for i in range(12)]
    got = {r.doc_id: r for r in S.remove_repeats(make_docs(rows)).collect()}
    for i, text in rows:
        assert (long if i % 2 == 0 else short) in text
        assert got[i].n_removed >= len(long) if i % 2 == 0 else got[i].n_removed == 0
        assert (long.encode() in got[i].kept) is False
        assert (short.encode() in got[i].kept) is (i % 2 == 1)
    check(spark, make_docs, rows)


def test_passage_in_many_documents(spark, make_docs):
    rng = random.Random(3)
    passage = words(rng, 100)[:420]
    rows = [(i, words(rng, 50) + passage + words(rng, 50)) for i in range(300)]
    check(spark, make_docs, rows)


def test_empty_table(spark, make_docs):
    assert S.remove_repeats(make_docs([]).limit(0)).count() == 0


def test_triggers_depend_on_the_string_only():
    rng = random.Random(4)
    text = words(rng, 300).encode()
    import numpy as np
    at = S.triggers(np.frombuffer(text, np.uint8))
    part = S.triggers(np.frombuffer(text[333:333 + 700], np.uint8))
    assert (at[333:333 + len(part)] - 333 == part).all()
    assert ((at - np.arange(len(at)) >= 0) & (at - np.arange(len(at)) <= S.GAP - S.ROLL)).all()
