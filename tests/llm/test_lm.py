"""Stupid-backoff scores against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from rotorsight.llm import lm


def brute(rows):
    texts = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
             for _, t in rows]
    one = Counter(w for t in texts for w in t)
    two = Counter(p for t in texts for p in zip(t, t[1:]))
    total, out = sum(one.values()), []
    for (doc_id, _), t in zip(rows, texts):
        own, logs = Counter(zip(t, t[1:])), []
        for v, w in zip(t, t[1:]):
            c = two[v, w] - own[v, w]
            logs.append(math.log2(c / one[v]) if c else math.log2(0.4 * one[w] / total))
        out.append((doc_id, len(t), sum(logs) / len(logs) if logs else None))
    return out


def some_rows(seed):
    rng = random.Random(seed)
    names = ["The", "of", "É", "Zed\x0bz"] + [f"w{i}" for i in range(200)]
    weights = [300, 200, 50, 5] + [200 / (i + 1) for i in range(200)]
    rows = [(None, None), (1, ""), (2, "one"), (3, "\n \t"), (4, "a a a a"), (5, "x y"), (5, "x y")]
    rows += [(i, " ".join(rng.choices(names, weights, k=rng.randint(0, 80)))) for i in range(6, 200)]
    return rows + [(300, " ".join(rng.choices(names, k=30000)))]


@pytest.mark.parametrize("hot,bucket,pack", [(1 << 16, 1_000_000, 5000), (64, 3000, 50), (4, 500, 7)])
def test_equals_brute_force(spark, make_docs, monkeypatch, tmp_path, hot, bucket, pack):
    monkeypatch.setattr(lm, "PACK_DOCS", pack)
    rows = some_rows(hot)
    make_docs(rows).write.parquet(str(tmp_path / "docs"))
    got = lm.scores(spark.read.parquet(str(tmp_path / "docs")), hot, bucket).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for (_, _, a), (_, _, b) in zip(got, want):
        assert (a is None and b is None) or a == pytest.approx(b, abs=1e-5)


def test_empty_table(spark, make_docs):
    assert lm.scores(make_docs([]).limit(0)).count() == 0
    assert [tuple(r) for r in lm.scores(make_docs([(1, None)])).collect()] == [(1, 0, None)]
