"""Aho-Corasick automata against plain substring search; blocks, lanes, clause scores."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rotorsight.operators import manual, terms as T


def plain(texts, terms):
    return {(i, t) for i, text in enumerate(texts) for t in set(terms) if t in text}


def found(texts, terms):
    tree = T.automaton(terms)
    pairs = list(zip(*T.occurrences(tree, texts)))
    assert len(set(pairs)) == len(pairs)
    return {(int(i), tree.terms[j]) for i, j in pairs}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab轴é", max_size=30), max_size=6),
       st.lists(st.text("ab轴é\U0001F600", min_size=1, max_size=5), max_size=12))
def test_equals_substring_search(texts, terms):
    assert found(texts, terms) == plain(texts, terms)


@pytest.mark.parametrize("lane", [1, 2, 7, 512])
def test_terms_across_lanes(monkeypatch, lane):
    monkeypatch.setattr(T, "LANE", lane)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 400))) for _ in range(20)]
    terms = ["a", "aa", "ab", "bab", "abcabc", "c" * 5] + [
        t[i:i + 9] for t in texts if len(t) > 50 for i in (0, 20, len(t) - 9)]
    assert found(texts, terms) == plain(texts, terms)


def test_hundred_thousand_terms():
    """As many states as characters at most, and every planted term is found in one pass."""
    rng = random.Random(2)
    terms = {"".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 12)))
             for _ in range(100_000)}
    planted = rng.sample(sorted(terms), 300)
    texts = [" ".join(planted[i:i + 3]) for i in range(0, 300, 3)]
    tree = T.automaton(sorted(terms))
    assert len(tree.fail) <= sum(map(len, terms)) + 1
    assert sum(x.nbytes for x in (tree.keys, tree.fail, tree.term, tree.more)) <= 33 * len(tree.fail)
    got = {(int(i), tree.terms[j]) for i, j in zip(*T.occurrences(tree, texts))}
    want = {(i, text[a:z]) for i, text in enumerate(texts) for a in range(len(text))
            for z in range(a + 4, min(a + 12, len(text)) + 1) if text[a:z] in terms}
    assert got == want and len(want) >= 300


def test_long_text_is_linear():
    """A megabyte of one letter with nested terms: matches are reported once."""
    assert found(["a" * 1_000_000], ["a", "aa", "aaa", "b"]) == {(0, "a"), (0, "aa"), (0, "aaa")}


@pytest.mark.parametrize("block", [1, 10, 1 << 20])
def test_blocks_of_terms(spark, block):
    rows = [(1, "泵轴承温度高"), (2, ""), (3, None), (None, "轴承"), (4, "no match"), (4, "温度")]
    terms = ["轴承", "温度", "温度高", "轴", "", None, "轴承"]
    got = T.found_terms(spark.createDataFrame(rows, "id long, note string"), "id", F.col("note"),
                        spark.createDataFrame([(t,) for t in terms], "t string"), block).collect()
    want = {(i, t) for i, x in rows for t in terms if x and t and t in x}
    assert {tuple(r) for r in got} == want
    none = T.found_terms(spark.createDataFrame(rows, "id long, note string"), "id", F.col("note"),
                         spark.createDataFrame([], "t string"))
    assert none.count() == 0


def test_clause_scores_equal_plain(spark):
    rng = random.Random(3)
    words = ["VIB_DE_TRIP", "轴承", "轴", "温", "温度高", "leak", "lea", "E-01", ""]
    clauses = [("m", f"c{i}", rng.sample(words, rng.randint(0, 2)), rng.sample(words, rng.randint(0, 3)))
               for i in range(40)]
    cases = [(f"t{i}", rng.sample(["VIB_DE_TRIP", "FLOW_DEV", "温"], rng.randint(0, 2)),
              rng.choice([None, "", "轴承温度高", "a leak", "VIB_DE_TRIPX"]),
              rng.choice([None, "E-01", "E-02"])) for i in range(30)]
    got = manual.clause_scores(
        spark.createDataFrame(cases, "trace_id string, flags array<string>, text string, alarm_code string"),
        spark.createDataFrame(clauses, "doc_id string, chunk_id string, rule_codes array<string>, "
                                       "keywords array<string>")).collect()
    want = {}
    for trace, flags, text, alarm in cases:
        note = (text or "") + " " + (alarm or "")
        for _, chunk, codes, keys in clauses:
            hits = sum(bool(t) and (t in flags or t in note) for t in codes + keys)
            if hits:
                want[trace, chunk] = (hits, len(codes + keys))
    assert {(r.trace_id, r.chunk_id): (r.hits, r.n_terms) for r in got} == want


def test_alphabet_beyond_terms():
    tree = T.automaton(["b"])
    assert list(tree.letters(np.array([0, 97, 98, 99], np.uint32))) == [0, 0, 1, 0]
