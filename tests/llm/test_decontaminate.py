"""Benchmark windows against brute force, with hot shingles and long words too."""

import random
import re

from rotorsight.llm import decontaminate as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        w, hit, owners = words(text), set(), set()
        for item, t in items:
            if item is None or t is None:
                continue
            v = words(t)
            size = min(10, len(v))
            for i in range(len(v) - size + 1) if v else ():
                for j in range(len(w) - size + 1):
                    if w[j:j + size] == v[i:i + size]:
                        hit.update(range(j, j + size))
                        owners.add(str(item))
        out.append((doc_id, len(w), sorted(hit), sorted(owners)))
    return sorted(out, key=str)


def case():
    rng = random.Random(1)
    pool = ["a", "b", "The", "é", "x9", "rare" ] + [f"w{i}" for i in range(30)]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(pool, k=n))
    items = [(1, text(40)), (2, text(9)), (3, "q"), (4, ""), (5, None), (None, text(12)), (6, text(10)),
             (6, text(10)), (7, "A b a b a b a b a b a b"), (10, "only here"), (11, "!!")]
    rows = [(None, None), (1, ""), (2, "..."), (3, "Q"), (4, items[0][1]), (4, items[0][1]),
            (5, "a b " * 30), (6, text(3000) + " " + items[0][1][10:] + " " + text(50))]
    for i in range(10, 80):
        part = words(rng.choice([t for _, t in items if t]))
        at = rng.randint(0, len(part))
        rows.append((i, text(rng.randint(0, 30)) + " " + " ".join(part[at:at + rng.randint(1, 20)])
                     + " " + text(rng.randint(0, 30))))
    return rows, items


def run(spark, make_docs, rows, items):
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, hits string")
    got = D.contamination(make_docs(rows), bench).drop("k1", "k2").collect()
    return sorted(map(tuple, got), key=str)


def test_equals_brute_force(spark, make_docs):
    rows, items = case()
    assert run(spark, make_docs, rows, items) == brute(rows, items)


def test_hot_shingles_and_full_filter(spark, make_docs, monkeypatch):
    rows, items = case()
    rows += [(100 + i, "so " + items[0][1] + f" end{i}") for i in range(40)]
    monkeypatch.setattr(D, "HOT_SHARE", 0.01)
    monkeypatch.setattr(D, "SALTS", 3)
    monkeypatch.setattr(D, "PLACES", 2)
    monkeypatch.setattr(D, "MAX_SLOTS_LOG", 1)
    assert run(spark, make_docs, rows, items) == brute(rows, items)


def test_long_words_are_told_apart(spark, make_docs):
    long = "z" * 100000
    items = [(1, f"one {long} two"), (2, f"one {long}y two"), (3, "é" * 40 + " b")]
    rows = [(1, f"x One {long} two"), (2, f"one {long}y two {long}"), (3, "É" * 40 + " b"),
            (4, "é" * 40 + " B"), (5, None), (6, f"two {long} one")]
    assert run(spark, make_docs, rows, items) == brute(rows, items)


def test_filter_never_loses_a_shingle(spark):
    import numpy as np
    values = np.random.default_rng(5).integers(-2 ** 63, 2 ** 63 - 1, 5000)
    table = D.bloom(spark.createDataFrame([(int(v),) for v in values], "shingle long"), len(values))
    assert D.passes(table, values).all()
    others = np.random.default_rng(6).integers(-2 ** 63, 2 ** 63 - 1, 20000)
    assert D.passes(table, others).mean() < 0.05


def test_empty_tables_and_clean(spark, make_docs):
    rows, items = case()
    assert run(spark, make_docs, rows, []) == brute(rows, [])
    assert run(spark, make_docs, [], items) == []
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(rows)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[2] for r in brute(rows, items))
