"""Quality and language: held-out accuracy, edge cases, and the mathematics against plain forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorsight.llm import language as L, quality as Q, queries

TEXTS = [None, "", " ", "12 34 !!", "a", "ñ", "x" * 50000, "The end. " * 2000, "日本語"]


def test_quality_on_held_out_labels(spark, sf_dir):
    rows = queries.QUERIES["op5_quality"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = rows.filter("held_out").join(labels, "doc_id").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    everything = rows.toPandas()
    assert everything["score"].between(0, 1).all()
    assert ((everything["score"] >= 0.5) == (everything["predicted"] == 1)).all()
    assert everything["doc_id"].is_unique and len(everything) == spark.read.parquet(
        f"{sf_dir}/documents.parquet").count()


def labelled(spark, make_docs, rows):
    docs = make_docs([(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, label int")
    return docs.select("doc_id", Q.stats().alias("stats")).join(labels, "doc_id")


def test_quality_takes_any_text_and_label(spark, make_docs):
    rows = [(t, i % 2) for i, t in enumerate(TEXTS)] + [("good prose here", None)]
    model = Q.fit(labelled(spark, make_docs, rows))
    docs = make_docs(list(enumerate(TEXTS)))
    got = docs.select("doc_id", Q.score(model).alias("s")).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["s"] <= 1 for r in got)
    assert docs.limit(0).select(Q.score(model)).count() == 0
    same = docs.select("doc_id", Q.stats().alias("stats")).select("doc_id", Q.score_of_stats(model).alias("s"))
    assert sorted(same.collect()) == sorted(got)


@pytest.mark.parametrize("rows,want", [([], 0.5), ([("a", 1), ("b", 1)], 1.0), ([("a", 0)], 0.0)])
def test_quality_without_two_labels(spark, make_docs, rows, want):
    model = Q.fit(labelled(spark, make_docs, rows))
    assert make_docs([(1, "x")]).select(Q.score(model)).first()[0] == want


def test_normal_equations_equal_least_squares(spark, make_docs):
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(["a", "bb", "ccc!", "1"], rng.integers(1, 40))), int(rng.integers(0, 2)))
            for _ in range(60)]
    model = Q.fit(labelled(spark, make_docs, rows))
    x = model.features(Q._stats_of(pd.Series([t for t, _ in rows])))
    y = np.array([v for _, v in rows], float)
    beta = np.linalg.solve(x.T @ x + Q.RIDGE * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(model.beta, beta, atol=1e-6)


def test_isotonic_is_the_best_ascending_fit():
    rng = np.random.default_rng(2)
    total = rng.integers(0, 5, 40).astype(float)
    good = np.floor(rng.random(40) * (total + 1))
    steps = Q.isotonic(good, total)
    assert (np.diff(steps) >= 0).all() and len(steps) == 40
    used = total > 0
    share = good[used] / total[used]
    prefix = lambda i, j: good[used][i:j + 1].sum() / total[used][i:j + 1].sum()
    n = used.sum()       # the min-max formula of isotonic regression
    want = [max(min(prefix(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    assert np.allclose(steps[used], want) and len(share) == n


def test_language_on_held_out_documents(spark, sf_dir):
    rows = queries.QUERIES["op3_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = rows.filter("held_out").join(docs, "doc_id").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert rows.count() == docs.count()


def test_language_of_any_text(spark, make_docs):
    rows = [("the house and the end", "en"), ("das Haus und der Hof", "de"), ("la casa y el perro", "es"),
            ("le chien et la maison", "fr"), ("talo ja koira", "fi"), ("xx yy", "zz"), (None, "en"),
            ("no label", None), ("1 2 3", "en"), ("", "de")] * 2
    frame = spark.createDataFrame(rows, "text string, lang string")
    model = L.fit(frame)
    assert model.languages == ["de", "en", "es", "fi", "fr", "zz"]
    assert model.families == ["germanic", "romance", "uralic", "zz"]
    got = {r["text"]: r["p"] for r in frame.select("text", L.predict(model).alias("p")).collect()}
    for text, lang in rows:
        if text and lang and any(map(str.isalpha, text)):
            assert got[text]["lang_pred"] == lang
    docs = make_docs(list(enumerate(TEXTS)))
    out = [r[0] for r in docs.select(L.predict(model)).collect()]
    assert all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == "und" for r in out) == 4
    assert docs.limit(0).select(L.predict(model)).count() == 0


def test_language_with_none_or_one_class(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert L.fit(empty).predict("abc") == ("und", 0.0)
    one = L.fit(spark.createDataFrame([("abc", "en")], "text string, lang string"))
    assert one.predict("xyz") == ("en", 1.0) and one.predict("12") == ("und", 0.0)
    two = L.fit(spark.createDataFrame([("abc abd", "en"), ("uvw uvx", "de")], "text string, lang string"))
    assert two.predict("abc")[0] == "en" and two.predict("uvw")[0] == "de"


def test_sample_is_bounded_and_blind_to_order(spark):
    rows = [(f"word{i} and more", "en") for i in range(300)] + [(f"wort{i} und mehr", "de") for i in range(9)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    a = L.fit(frame.repartition(5), sample=20)
    b = L.fit(frame.orderBy(F.desc("text")), sample=20)
    assert np.allclose(a.weights, b.weights)
    assert a.predict("word5 and more")[0] == "en" and a.predict("wort5 und mehr")[0] == "de"
