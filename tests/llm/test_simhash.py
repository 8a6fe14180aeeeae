"""Fingerprints and components against brute force; the bit-sliced comparison against plain XOR."""

import random
import re

import numpy as np
import xxhash

from rotorsight.llm import simhash as S


def brute_print(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None)
             for g in group}
    return sorted(((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group)), key=str)


def test_equals_brute_force(spark, make_docs):
    rng = random.Random(1)
    words = ["Alpha", "beta", "Éta", "gam\x0bma", "x", "long" * 30]
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (5, "one two")]
    base = [rng.choice(words) + str(rng.randint(0, 50)) for _ in range(400)]
    for i in range(10, 60):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(400)] = "new"
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(60, 120)]
    got = S.near_duplicates(make_docs(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert S.near_duplicates(make_docs([]).limit(0)).count() == 0
    kept = S.keep_one(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert kept.count() == len({c for _, _, c in brute(rows)})


def chains(seed, n):
    """Fingerprints of which many are close: small steps from a few starts."""
    rng = random.Random(seed)
    values = {0, (1 << 64) - 1}
    for _ in range(n):
        v = rng.choice(sorted(values)[:50]) if rng.random() < .8 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            v ^= 1 << b
        values.add(v)
    return np.array(sorted(values), np.uint64)


def classes(values):
    label = list(range(len(values)))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    changed = True
    while changed:
        changed = False
        for i, row in enumerate(near):
            least = min(label[j] for j in np.nonzero(row)[0])
            if least < label[i]:
                label[i], changed = least, True
    return label


def test_forest_links_all_close_members():
    for seed, n in ((1, 40), (2, 150), (3, 300)):
        values = chains(seed, n)
        labels = S.forest(values, np.array([0, len(values)]))
        want = classes(values)
        assert len({(int(a), b) for a, b in zip(labels, want)}) == len(set(want)) == len(set(labels.tolist()))


def test_within_counts_any_small_radius():
    rng = np.random.default_rng(5)
    members = rng.integers(0, 1 << 63, 64).astype(np.uint64)
    query = members[7] ^ np.uint64(0b1011)
    block = S.planes(members)
    for radius in range(4):
        hit = S.within(np.array([query]), block, np.array([~np.uint64(0)]), radius)[0]
        want = sum(1 << i for i, m in enumerate(members) if int(m ^ query).bit_count() <= radius)
        assert int(hit) == want


def test_links_of_all_tables_and_hot_buckets(spark, monkeypatch):
    values = chains(7, 200)
    want = classes(values)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    for bucket in (4096, 3):
        monkeypatch.setattr(S, "BUCKET", bucket)
        roots = dict(map(tuple, S.components(S.links(frame)).collect()))
        got = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))
