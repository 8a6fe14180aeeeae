"""Fingerprints against brute force; merging, unequal documents, order of neighbours."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from rotorsight.llm import sketch as S


def brute_sketch(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    hashes = {hashlib.md5(" ".join(w[i:i + 5]).encode()).hexdigest()[:16]
              for i in range(max(len(w) - 4, 1))} if w else set()
    return sorted(h for h in hashes if h < "2" or h == min(hashes))


def likeness(a, b):
    return len(set(a) & set(b)) / len(a) if a else float(not b)


def brute(rows):
    """Rows (doc_id, text) with different ids, in any order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + u[:half]
        own, ed = brute_sketch(t), brute_sketch(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(ed),
                    likeness(own, ed), likeness(own, brute_sketch(u)), j))
    return sorted(out, key=str)


COLUMNS = ("doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next "
           "next_id").split()


def prose(rng, n):
    return " ".join(rng.choice(["the", "é", "字", "of", "\U0001F600", f"w{rng.randint(0, 999)}"])
                    for _ in range(n))


def test_equals_brute_force(spark, make_docs):
    rng = random.Random(8)
    rows = [(None, "no id"), (3, None), (5, ""), (8, " \t\x0b\n"), (9, "one"), (10, "a b c d e"),
            (11, "x" * 300000), (12, prose(rng, 20000)), (13, "﻿ b c d")]
    rows += [(rng.randint(100, 10 ** 12), prose(rng, rng.choice([3, 40, 300]))) for _ in range(80)]
    rows += [(i, "same text of many documents, long enough for shingles") for i in range(20, 60)]
    got = S.fingerprints(make_docs(rows, "k1 long, h long, n int, part int, copies int")).select(
        *COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_repeated_rows_and_empty_table(spark, make_docs):
    rows = [(1, "a b c d e f g"), (2, "h i j k l m"), (2, "h i j k l m"), (3, "n o p")]
    got = S.fingerprints(make_docs(rows)).select(*COLUMNS).collect()
    want = brute(rows[:2] + rows[3:])
    assert sorted(map(tuple, got), key=str) == sorted(want + [r for r in want if r[0] == 2], key=str)
    assert S.fingerprints(make_docs(rows).limit(0)).count() == 0
    alone = S.fingerprints(make_docs(rows[:1])).first()
    assert (alone.near_next, alone.next_id) == (1.0, 1)


def test_equal_ids_follow_by_hash(spark, make_docs):
    rows = [(7, f"text number {i} with some words") for i in range(9)]
    got = S.fingerprints(make_docs(rows)).collect()
    assert len(got) == 9 and len({r.edited_sha256 for r in got}) == 9


def test_sketches_merge(spark):
    rng = random.Random(4)
    rows = [(prose(rng, rng.choice([0, 2, 7, 80])), prose(rng, rng.choice([0, 3, 200])))
            for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string")
    for name in "ab":
        df = S.with_sketch(df, name, f"s{name}")
    df = df.select("a", "b", S.merge(F.col("sa"), F.col("sb")).alias("m"),
                   (S.unpack(S.pack(F.col("sa"))) == F.col("sa")).alias("again"))
    for r in df.collect():
        both = {h for t in (r.a, r.b) for h in brute_all(t)}
        assert r.m == sorted(h for h in both if h < "2" or h == min(both))
        assert r.again


def brute_all(text):
    w = text.split(" ") if text else []
    return {hashlib.md5(" ".join(w[i:i + 5]).encode()).hexdigest()[:16]
            for i in range(max(len(w) - 4, 1))} if w else set()


def test_containment_of_unequal_documents(spark):
    """A passage of 400 words inside 20,000: its containment is near one, the other way near 2 %."""
    rng = random.Random(6)
    big = [f"w{rng.randint(0, 50000)}" for _ in range(20000)]
    df = spark.createDataFrame([(" ".join(big[5000:5400]), " ".join(big))], "a string, b string")
    for name in "ab":
        df = S.with_sketch(df, name, f"s{name}")
    r = df.select(S.containment(F.col("sa"), F.col("sb")).alias("small"),
                  S.containment(F.col("sb"), F.col("sa")).alias("large"), F.size("sb").alias("n")).first()
    assert r.small > 0.97 and abs(r.large - 0.02) < 0.01
    assert abs(r.n / 19996 - S.FRACTION) < 0.02
