"""Boilerplate lines against brute force."""

import random
from collections import defaultdict

from rotorsight.llm import line_dedup as D


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\r\x0b\x0c") and source is not None:
                sites[line].add(source)
    out = []
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(sites[x]) < min_sites]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(1)
    common = [(f"line shared {n}", n) for n in (1, 2, 9, 10, 11, 30, 200)] + [(" ", 40), ("", 40)]
    rows = [(None, None, "s0"), (1, "", None), (2, "\n\n", "s1"), (3, "only line", None), (4, "é\r\né\r", "s2")]
    for i in range(10, 400):
        site = i % 250
        lines = [line for line, n in common if site < n] + ["\r", "\t\x0b", "\u00a0"] + [f"own {i}", "same" if i == 11 else "x" * 50]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{site}"))
    return rows + [rows[20], rows[20]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows],
                                 "doc_id long, text string, source string, gone int, line string"
                                 ).repartition(3)


def test_equals_brute_force(spark):
    for min_sites in (1, 2, 10, 100):
        got = D.clean_lines(frame(spark, some_rows()), min_sites).collect()
        assert sorted(map(tuple, got), key=str) == brute(some_rows(), min_sites)


def test_empty_table(spark):
    assert D.clean_lines(frame(spark, some_rows()).limit(0)).count() == 0


def test_blank_lines_of_crlf_documents_stay(spark):
    rows = [(i, f"unique {i}\r\n\r\n\t\nend\r\n", f"s{i}") for i in range(12)]
    got = D.clean_lines(frame(spark, rows)).collect()
    assert {(r.n_lines, r.n_removed) for r in got} == {(5, 1)}
    assert all(r.text == f"unique {r.doc_id}\r\n\r\n\t\n" for r in got)


def test_many_lines_in_one_document(spark):
    """100,000 lines, every other one removed: seconds, not hours."""
    rows = [(i, "\n".join(f"shared {j}" for j in range(50_000)), f"s{i}") for i in range(10)]
    rows.append((99, "\n".join(f"shared {j}\nown {j}" for j in range(50_000)), "s99"))
    got = {r.doc_id: r for r in D.clean_lines(frame(spark, rows)).collect()}
    assert (got[99].n_lines, got[99].n_removed) == (100_000, 50_000)
    assert got[99].text == "\n".join(f"own {j}" for j in range(50_000))
