"""Filter interaction audit against brute force over all orders."""

import random
from itertools import permutations

from rotorsight.llm import filter_audit as A


def failures(rows):
    """Per row (doc_id, text, lang) the letters of the filters that it fails."""
    out = []
    for doc_id, text, _ in rows:
        body = text or ""
        words = [w for w in body.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in body) > 10 * len(body):
            fails.add("C")
        if set(body) & set("#$%&*|"):
            fails.add("D")
        if doc_id is not None and any(
                i is not None and i < doc_id and (t or "") == body for i, t, _ in rows):
            fails.add("E")
        out.append(fails)
    return out


def brute(rows, labels):
    fails = failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        some = []
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                some.append([part, "".join(order), step, len(left), len(gone),
                             sum(letter in f for _, f in mine) - len(gone),
                             sum(f == {letter} for _, f in mine),
                             sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter])
        out += [(*x[:-1], shapley[x[-1]]) for x in some]
    return sorted(out)


def some_rows():
    rng = random.Random(5)
    rows = [(None, None, None), (None, None, "en"), (1, None, "en"), (2, "", ""), (3, "", "en"),
            (4, " \t\x0b", "de"), (5, "a" * 100000, "de"), (6, "É é" * 40, "de"), (7, "x y", "en")]
    long = " ".join(f"word{i}" for i in range(120))
    rows += [(10 + i, long, "en") for i in range(30)] + [(10, long, "en"), (10, long, "fr")]
    for i in range(60, 120):
        n = rng.choice([5, 99, 100, 101, 150])
        words = [rng.choice(["ab", "AB", f"u{j}", f"v{j}", "w\tx", "é"]) for j in range(n)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words) + rng.choice(["", "$", " | "]),
                     rng.choice(["en", "fr"])))
    rows += rng.choices(rows, k=15)
    return rows


LABELS = [(i, i % 2, (i // 3) % 2) for i in range(1, 100)] + [(12, 1, 1), (12, 0, 0), (None, 1, 1),
                                                              (14, None, None)]
COLUMNS = ("part filter_order step kept removed redundant unique_fails good_lost toxic_lost "
           "shapley").split()


def tables(spark, rows, labels=LABELS):
    data = [(*r, "s", 0, 0) for r in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, "
                                       "mask int, n int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark):
    rows = some_rows()
    got = A.audit(*tables(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute(rows, LABELS)


def test_hash_collisions_are_no_copies(spark, monkeypatch):
    """With one hash for all texts the texts themselves decide."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(A, "text_hash", lambda: F.lit(7).cast("long"))
    rows = [(i, f"text {i % 4}", "en") for i in range(20)]
    got = A.audit(*tables(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute(rows, LABELS)


def test_empty_tables(spark):
    docs, labels = tables(spark, some_rows())
    assert A.audit(docs.limit(0), labels).count() == 0
    got = A.audit(docs, labels.limit(0)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute(some_rows(), [])


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "x", "en"), ("a", "x", "en"), ("c", "y", None)],
                                 "doc_id string, text string, lang string")
    rows = A.combinations(docs, spark.createDataFrame([], "doc_id string, quality int, toxic int"))
    assert sorted((r.part, r["mask"], r.n) for r in rows.collect()) == [("", 1, 1), ("en", 1, 1), ("en", 17, 1)]
