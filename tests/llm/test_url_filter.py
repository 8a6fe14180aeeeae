"""URL verdicts against brute force."""

import random

from rotorsight.llm import url_filter as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return low, path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]


def brute(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        host, path = split(url)
        fits = [(len(h) + len(p), len(h), a, h + p) for h, p, a in rules
                if None not in (h, p, a) and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[3], best[2] if best else default))
    return sorted(out, key=str)


def run(spark, rows, rules):
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows],
                                  "page_id long, url string, host string, salt int").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = U.judge(pages, table)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, got.collect()), key=str)


def some_rows():
    rng = random.Random(1)
    hosts = ["net", "example.net", "www.EXAMPLE.net", "a.b.example.net", "badexample.net", "example.com",
             "org", "x.org", "orgs", "", ".", "net.", "a..net", "é.net", "net\x01", "user@example.net"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/y?z", "/fr/#f", "?q", "#/", "/é/", "/en/x/y://z", "/\n"]
    rows = [(None, None), (1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "a://b://net/")]
    rows += [(i, rng.choice(["http", "HTTPS", ""]) + "://" + rng.choice(hosts) + rng.choice(paths))
             for i in range(10, 400)]
    return rows + rows[50:60]


def test_rules_of_the_query(spark):
    assert run(spark, some_rows(), U.RULES) == brute(some_rows(), U.RULES)


def test_many_nested_rules(spark):
    rng = random.Random(2)
    hosts = ["net", "example.net", "www.example.net", "b.example.net", "com", "é.net", "org", "x.org", ""]
    paths = ["", "/", "/e", "/en/", "/en/x", "/en/x/y", "/d", "/é", "/fr/"]
    rules = [(h, p, "block" if rng.random() < .5 else "allow") for h in hosts for p in paths
             if rng.random() < .7]
    rules = list({(h, p): (h, p, a) for h, p, a in rules}.values())
    rules += [(None, "/", "block"), ("net", None, "block"), ("net", "/", None)]
    assert run(spark, some_rows(), rules) == brute(some_rows(), rules)


def test_equal_rules_block(spark):
    rules = [("net", "/", "allow"), ("net", "/", "block")]
    assert run(spark, [(1, "http://a.net/")], rules) == [(1, "a.net", "/", "net/", "block")]


def test_hot_host_is_spread(spark):
    rows = [(i, f"http://hot.net/{'en' if i % 2 else 'de'}/{i}") for i in range(2000)]
    assert run(spark, rows, U.RULES) == brute(rows, U.RULES)


def test_empty_tables(spark):
    assert run(spark, [], U.RULES) == []
    assert run(spark, [(1, "http://a.net/x")], []) == [(1, "a.net", "/x", None, "allow")]
