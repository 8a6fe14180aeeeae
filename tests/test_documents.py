"""Document structure, chunking and file sources on small fixtures."""

import random

from pyspark.sql import functions as F

from rotorsight import limits as L
from rotorsight.functions.text import heading_level, normalise, quality_features
from rotorsight.operators import chunking, documents
from rotorsight.plans import knowledge, standin
from rotorsight.sources import documents as sources

PAGE_SCHEMA = ("source string, file_type string, part long, page int, sheet_name string, "
               "text string")


def test_normalise_and_heading_levels(spark):
    raw = "﻿T\\_b &amp; &lt;x&gt;  y  \nA​B   C\n\n\n\nD&eacute;"
    assert spark.range(1).select(normalise(F.lit(raw))).first()[0] == "T_b & <x> y\nAB C\n\nDé"
    lines = {"# A": 1, "### A b": 3, "1 安全使用须知": 1, "2.1 设备定位": 2, "15 min 短期趋势": None,
             "100 45 74 曲线": None, "1 泵体充液 □": None, "附录B 监测点定义": None,
             "附录 E 仿真": 1, "Appendix A data": 1, "一、总则": 1, "二、结束。": None,
             "1 " + "长" * 20: None, "正文": None}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    got = {r[0]: r[1] for r in df.select("line", heading_level("line")).collect()}
    lines["附录B 监测点定义"] = 1
    assert got == lines


def test_records_follow_the_stack_across_pages(spark):
    pages = [("m", "pdf", 1, 1, None, "cover page text\n1 总则\nbody of one"),
             ("m", "pdf", 2, 2, None, "continued body\n\n| a | b |\n|---|---|\n| 1 | 2 |\n- item one\n- item two"),
             ("m", "pdf", 3, 3, None, "2.1.1 深层\nnested text here\n2.1.2 并列\nmore nested text"),
             ("plain", "markdown", 0, None, None, "no headings at all here"),
             ("toc", "pdf", 1, 1, None, "1 甲\n2 乙\n3 丙\ntext after contents")]
    rows = documents.records(spark.createDataFrame(pages, PAGE_SCHEMA)) \
        .orderBy("source", "ordinal").collect()
    got = [(r.source, r.part, r.content_type, "/".join(r.section_path), r.raw_text) for r in rows]
    assert got == [
        ("m", 1, "text", "1 总则", "1 总则\nbody of one"),
        ("m", 2, "text", "1 总则", "continued body"),
        ("m", 2, "table", "1 总则", "| a | b |\n|---|---|\n| 1 | 2 |"),
        ("m", 2, "list", "1 总则", "- item one\n- item two"),
        ("m", 3, "text", "1 总则/2.1.1 深层", "2.1.1 深层\nnested text here"),
        ("m", 3, "text", "1 总则/2.1.1 深层/2.1.2 并列", "2.1.2 并列\nmore nested text"),
        ("plain", 0, "text", "", "no headings at all here"),
        ("toc", 1, "text", "", "1 甲\n2 乙\n3 丙\ntext after contents")]


def test_repeated_lines_are_removed(spark):
    pages = [("m", "pdf", i, i, None, f"ACME manual\nunique line {i} with words\nmiddle\nx{i}\ny{i}\npage foot")
             for i in range(5)]
    clean = documents.drop_header_lines(spark.createDataFrame(pages, PAGE_SCHEMA))
    rows = clean.orderBy("part").collect()
    assert rows[0].text == "unique line 0 with words\nx0\ny0"
    assert rows[0].removed == ["ACME manual", "middle", "page foot"]
    few = documents.drop_header_lines(spark.createDataFrame(pages[:2], PAGE_SCHEMA)).first()
    assert few.text == pages[0][-1]


def test_splitters():
    rnd = random.Random(1)
    text = "".join(rnd.choice("甲乙丙丁abc") * rnd.randint(1, 9) + rnd.choice("。，；\n ")
                   for _ in range(900))
    pieces = chunking.split_text(text)
    assert all(0 < len(p) <= L.CHUNK_SIZE for p in pieces)
    at = 0
    for piece in pieces:       # in order, overlapping by at most the allowed amount, nothing lost
        found = text.find(piece, max(0, at - L.CHUNK_OVERLAP - 2))
        assert 0 <= found and not text[at:found].strip()
        at = found + len(piece)
    assert not text[at:].strip()
    assert chunking.split_text("x" * 1200) == ["x" * 500, "x" * 500, "x" * 360]
    table = "\n".join(["| h |", "|---|"] + [f"| {i:090d} |" for i in range(20)])
    groups = chunking.split_table(table)
    assert len(groups) > 1 and all(g.startswith("| h |\n|---|\n") for g in groups)
    assert [r for g in groups for r in g.split("\n")[2:]] == table.split("\n")[2:]
    items = "\n".join(f"- {i} " + "y" * 100 for i in range(12))
    lists = chunking.split_list(items)
    assert "\n".join(lists) == items and all(p.startswith("- ") for p in lists)


def test_build_is_idempotent(spark):
    text = "# A\n" + "。".join(f"句子{i}" * 6 for i in range(80)) + "\n- item\n" + "short tail text"
    pages = spark.createDataFrame([("s", "markdown", 0, None, None, text)], PAGE_SCHEMA)
    _, records, first = knowledge.build(pages)
    _, _, second = knowledge.build(pages)
    ids = sorted(r.chunk_id for r in first.collect())
    assert ids == sorted(r.chunk_id for r in second.collect()) and len(ids) == len(set(ids)) > 3
    assert chunking.upsert(first, second).count() == len(ids)


def test_file_sources_and_chunk_table(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# T\nbody text of a", encoding="utf-8")
    (tmp_path / "in" / "deep" / "b.markdown").write_text("  \n", encoding="utf-8")
    (tmp_path / "in" / "c.txt").write_text("ignored", encoding="utf-8")
    states = ["NORMAL"] * 120 + ["警告"] * 3 + ["NORMAL"]
    body = "\n".join(["t,operating_state", ""] + [f"{i},{s}" for i, s in enumerate(states)])
    (tmp_path / "in" / "d.csv").write_bytes(body.encode("gbk"))
    pages = sources.read_markdown(spark, str(tmp_path / "in"))
    assert [r.text for r in pages.collect()] == ["# T\nbody text of a"]
    report = sources.load_report(sources.list_files(spark, str(tmp_path / "in")), pages).first()
    assert (report.files_scanned, report.files_skipped, report.docs_loaded) == (2, 2, 1)
    blocks = sources.csv_pages(sources.read_csv_rows(spark, str(tmp_path / "in")), 7) \
        .orderBy("part").collect()
    assert [(b.segment_value, b.row_count) for b in blocks] == [
        ("NORMAL", 50), ("NORMAL", 50), ("NORMAL", 20), ("警告", 3), ("NORMAL", 1)]
    assert blocks[0].text.startswith("t | operating_state\n0 | NORMAL\n1 | NORMAL")
    _, _, chunks = knowledge.build(pages)
    target = str(tmp_path / "chunks")
    assert sources.rebuild_chunks(chunks, target)
    sources.write_chunks(spark, chunks, target, stored=True)
    assert sources.read_chunks(spark, target).count() == chunks.count()
    assert not sources.rebuild_chunks(chunks.limit(0), target)
    assert sources.read_chunks(spark, target).count() == chunks.count()


def test_text_quality(spark):
    df = spark.createDataFrame([("Flow PV 98.2 m3/h, TEMP 71 °C, tag TAH-101 rpm 2900",), ("ww Wink",)],
                               "text string")
    good, bad = [r.asDict() for r in df.select(*[v.alias(k) for k, v in
                                                 quality_features("text").items()]).collect()]
    assert good["units"] == ["m3/h", "rpm", "°c"] and good["tags"] == ["PV 98", "TAH-101", "TEMP 71"]
    assert good["keys"] == ["FLOW", "PV", "TAG", "TEMP"] and good["digits"] == 13
    assert bad == {"chars": 6, "digits": 0, "units": [], "tags": [], "keys": []}


def test_stand_in_pages_keep_every_line(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = standin.manual_pages(documents).withColumnRenamed("part", "doc_id").select(
        "doc_id", F.col("text").alias("page_text"))
    both = documents.join(pages, "doc_id")
    assert both.count() == documents.count()
    total = both.agg(F.sum(F.length("text")), F.sum(F.length("page_text"))).first()
    assert total[1] >= total[0]
    held = lambda line: F.exists(F.split("page_text", "\n"), lambda x: F.contains(x, line))
    assert both.filter(F.exists(F.split("text", "\n"), lambda line: ~held(line))).count() == 0


def plan_of(df, step="executedPlan"):
    return getattr(df._jdf.queryExecution(), step)().toString()


def test_upsert_moves_only_the_columns_that_are_read(spark):
    schema = "chunk_id string, text string, n int"
    stored = spark.createDataFrame([("a", "old", 1), ("b", "kept", 2)], schema)
    fresh = spark.createDataFrame([("a", "x", 3), ("a", "y", 4), ("c", "new", 5)], schema)
    table = chunking.upsert(stored, fresh)
    rows = {r.chunk_id: (r.text, r.n) for r in table.collect()}
    assert rows.pop("a") in {("x", 3), ("y", 4)}, "all columns come from one fresh copy"
    assert rows == {"b": ("kept", 2), "c": ("new", 5)}
    grouped = [x for x in plan_of(table.select("chunk_id", "n"), "optimizedPlan").split("\n")
               if "Aggregate" in x]
    assert grouped and not any("text" in x for x in grouped)


def test_a_text_is_normalised_in_single_steps(spark):
    texts = ["a&#8203;b", "A & B", "x&amp;y", "&", "& ;&&lt", "t \t\nu ", "p\\*q​", " r  s"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(normalise("text"))
    assert [r[0] for r in df.collect()] == ["a​b", "A & B", "x&y", "&", "& ;&<", "t\nu", "p*q", "r s"]
    assert plan_of(df, "optimizedPlan").count("RegExpReplace") + plan_of(df).count("(?dm)") <= 2


def test_lines_are_judged_where_they_are_read(spark):
    pages = [("m", "pdf", i, i, None, t) for i, t in enumerate([
        "1 a\n1 b\n\n1 c\nx", "# a\n# b\n# c", "| a |\n\n| b |\n|---|", None, " \n ", "- i\nw\n2.1 z"])]
    lines = documents.classify_lines(spark.createDataFrame(pages, PAGE_SCHEMA))
    got = [tuple(r) for r in lines.orderBy("part", "line_no").select(
        "part", "line_no", "heading", "type", "block", "heading_no").collect()]
    assert got == [
        (0, 0, False, "text", 1, 0), (0, 1, False, "text", 1, 0), (0, 3, False, "text", 1, 0),
        (0, 4, False, "text", 1, 0), (1, 0, True, "text", 1, 1), (1, 1, True, "text", 2, 2),
        (1, 2, True, "text", 3, 3), (2, 0, False, "text", 1, 0), (2, 2, False, "table", 2, 0),
        (2, 3, False, "table", 2, 0), (5, 0, False, "list", 1, 0), (5, 1, False, "text", 2, 0),
        (5, 2, True, "text", 3, 1)]
    assert "Exchange" not in plan_of(lines)
