"""Every stage against a plain version on its own input, and the whole run."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from rotorsight.llm import bpe
from rotorsight.llm.queries import quality_model, table, tokenizer
from rotorsight.llm import quality

from tests.llm.plain import decontaminated, near_groups


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    rows, model = quality_model(spark, sf_dir, docs)
    want = ids(rows.filter(quality.score_of_stats(model) >= 0.5))
    seen = []
    for name, stage in P.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append(name)
        texts = {r["doc_id"]: r["text"] or "" for r in before.collect()}
        if name == "quality":
            pass
        elif name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                key = re.sub("[\x20\x09-\x0d]", "", t)
                best[key] = min(best.get(key, (1, 0)), (-len(t), i))
            want = sorted(i for _, i in best.values())
        elif name == "near_dedup":
            want = sorted(min(g) for g in near_groups(texts))
        elif name == "decontamination":
            items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
            want = decontaminated(texts, items)
        else:
            codec = bpe.Codec(*tokenizer())
            for r in docs.collect():
                assert r["ids"] == codec.encode(texts[r["doc_id"]]).tolist()
                assert r["n_tokens"] == len(r["ids"]) and r["round_trip"]
            want = sorted(texts)
        assert ids(docs) == want, name
        assert name == "tokens" or docs.columns == columns
        assert docs.count() <= before.count()
    assert seen == ["quality", "exact_dedup", "near_dedup", "decontamination", "tokens"]
    assert ids(P.run(spark, sf_dir)) == want


def test_stages_take_nulls_repeated_rows_and_other_columns(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, k1 int"
    rows = [(None, None, None, None, None, None, None), (1, None, "en", "s", 0, True, 1),
            (1, None, "en", "s", 0, True, 1), (2, "The same text of some words.", "en", None, 3, None, 2),
            (3, "the same  text of some words.", None, "s", 3, None, None), (4, "x" * 40000, "en", "s", 1, None, 3),
            (4, "another text under one id", "en", "s", 1, None, 3)]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "tokens" or out.columns == docs.columns
            assert out.count() <= docs.count()
    docs = spark.createDataFrame(rows, kind)
    kept = P.drop_exact_copies(spark, docs, sf_dir).select("doc_id", F.length("text")).collect()
    assert sorted(map(tuple, kept), key=str) == [(1, None), (2, 28), (3, 29), (4, 25), (4, 40000)]
