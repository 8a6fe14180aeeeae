"""Tokenizer alignment against the two libraries, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from rotorsight.llm import align as A

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def tokens():
    return A.Tokenizers(*FILES)


def brute_document(text, tokens):
    """(n_a, n_b, n_groups, groups_sha256) and the linked id pairs, counted."""
    none = (0, 0, 0, ""), Counter()
    if not text:
        return none
    ids = (tokens.first.encode(" " + text, add_special_tokens=False).ids, tokens.second.encode(text))
    sides, ends = [], []
    for side, entries in zip(ids, (tokens.first_bytes, tokens.second_bytes)):
        at, spans = 0, []
        for i in side:
            spans.append((at, at + len(entries[i]), i))
            at += len(entries[i])
        if b"".join(entries[i] for i in side) != (" " + text).encode():
            return none
        sides.append(spans)
        ends.append({z for _, z, _ in spans})
    links, low = Counter(), 0
    for s, z, i in sides[0]:
        while sides[1][low][1] <= s:
            low += 1
        for t, y, j in sides[1][low:]:
            if t >= z:
                break
            links[i, j] += 1
    groups, both = [], sorted(ends[0] & ends[1])
    places = [iter(sides[0]), iter(sides[1])]
    for end in both:
        part = []
        for side in places:
            got = []
            for _, z, i in side:
                got.append(str(i))
                if z == end:
                    break
            part.append(",".join(got))
        groups.append("|".join(part))
    return (len(ids[0]), len(ids[1]), len(both),
            hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def brute(rows, tokens):
    found = [(i, *brute_document(t, tokens)) for i, t in rows]
    corpus = sum((links for *_, links in found), Counter())
    best = {}
    for (_, j), n in corpus.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((i, a, b, g, sum(links.values()),
                    sum(n for p, n in links.items() if corpus[p] == best[p[1]]),
                    sum(n * corpus[p] for p, n in links.items()), digest)
                   for i, (a, b, g, digest), links in found), key=str)


def odd_rows():
    rng = random.Random(2)
    parts = [*"ab Z.,'1<>|é\n\t中字̈ﬁ", " the", " of", "'s ", "<|endoftext|>", " <s>", " ",
             "　", "​", "\U0001F600", "\x00", "\u0085", " ", "  ", " д", " א", "s' "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " "), (503, "a▁b"), (504, "▁"), (505, "<0x41> <unk>"),
             (506, "word " * 30000), (507, "longwithoutspace" * 4000), (None, "no id"),
             (508, "same row"), (508, "same row"), (508, "other row")]
    return rows


def table(spark, rows):
    data = [(i, t, 1, "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, a int, row string").repartition(3)


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.mark.parametrize("share", [A.FREQUENT, 2.0, 0.01])
def test_equals_libraries(spark, tokens, monkeypatch, share):
    """Whatever is frequent: all pairs by the join, some, or all of them known to every task."""
    monkeypatch.setattr(A, "FREQUENT", share)
    rows = odd_rows()
    got = A.alignment(table(spark, rows), *FILES).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, tokens)


def test_small_bounds(spark, tokens, monkeypatch):
    for name, value in (("ENCODE_BYTES", 64), ("PIECES", 7), ("KNOWN", 20), ("PAIRS", 10)):
        monkeypatch.setattr(A, name, value)
    rows = odd_rows()[::4]
    rows = [(i, t) for i, t in rows if len(t or "") < 5000] + [(600, "many words of one text " * 30)]
    got = A.alignment(table(spark, rows), *FILES).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, tokens)


def test_given_table(spark, sf_dir, tokens):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = A.alignment(docs, *FILES).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(
        [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokens)


def test_empty_tables(spark):
    docs = table(spark, odd_rows())
    assert A.alignment(docs.limit(0), *FILES).count() == 0
    none = A.alignment(docs.filter("text is null or text = ''"), *FILES).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * len(none) and none


def test_cuts_are_boundaries(tokens):
    """Encoding the pieces gives the ids of the whole text."""
    import pyarrow as pa
    for _, text in odd_rows():
        if text:
            pieces, _ = A.split(pa.array([text]))
            assert "".join(pieces.to_pylist()) == " " + text
            a, b = tokens.encode(pieces.to_pylist())
            whole_a, whole_b = tokens.encode([" " + text])
            assert sum(a, []) == whole_a[0] and sum(b, []) == whole_b[0]
