"""CSV files cut anywhere against the standard library's reader."""

import csv
import io
import random

import pytest

from rotorsight.sources import csv_files, documents


def plain(data):
    """Rows of one file, or the reason why there are none."""
    for encoding in ("utf-8-sig", "gbk", "gb18030"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        return "unknown encoding"
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        return [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    except csv.Error as broken:
        return f"not readable as CSV: {broken}"


def check(spark, folder, files, split=None):
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 0}
    try:
        if split:
            for k, v in keys.items():
                spark.conf.set(k, v)
        got = csv_files.read_rows(spark, str(folder)).collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    for name, data in files.items():
        want = plain(data)
        rows = sorted((r for r in got if r.source.endswith("/" + name)), key=lambda r: r.row_no or 0)
        if isinstance(want, str):
            assert [(r.row_no, r.cells, r.error) for r in rows] == [(None, None, want)], name
        elif not want:
            assert [tuple(r)[1:] for r in rows] == [(None,) * 4] * bool(data), name
        else:
            assert [r.row_no for r in rows] == list(range(len(want))), name
            assert [r.cells for r in rows] == want and {tuple(r.header) for r in rows} == {tuple(want[0])}, name


def files(seed, count=14):
    rng = random.Random(seed)
    parts = ['"', '""', ",", "\n", "\n", "\r\n", "\r", "a", "b,c", '"x,y"', '"line\nbreak"', ' "', "é轴", "  "]
    made = {f"r{i}.csv": "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))).encode(
        rng.choice(["utf-8", "utf-8-sig", "gb18030"])) for i in range(count)}
    return made


ODD = {
    "empty.csv": b"", "blank.CSV": b"\n\r\n , \n", "header.csv": b"a,b", "bom.csv": b"\xef\xbb\xbfa,b\n1,2\n",
    "gbk.csv": "时间,状态\n1,警告\n\"多\n行\",正常\n".encode("gbk"), "four.csv": "a\n\U0001F600,x\n".encode("gb18030"),
    "none.csv": b"a,b\n\xff\xff\xff,1\n", "cr.csv": b"a,b\r1,2\r\r3,4", "open.csv": b'a,b\n1,"never\nclosed\n2,3\n',
    "wide.csv": b"t,state\n" + b"x" * 200_000 + b",ON\n", "inner.csv": b'a,b\n1,x"y\n2,"q"z"\n3,"""\n",4\n',
    "nul.csv": b"a,b\n1,\x00\n",
}


def test_odd_files(spark, tmp_path):
    check(spark, tmp_path / "in", ODD)


def test_random_files(spark, tmp_path):
    check(spark, tmp_path / "in", files(1, 60))


@pytest.mark.parametrize("split", [4, 11])
def test_cut_anywhere(spark, tmp_path, split):
    """The same rows whatever number of bytes a block has."""
    text = 'a,b\n1,"x\n""y"",\nz"\n\n2,"\r\nr"\n3,p"q\n"4",""""\n'
    check(spark, tmp_path / "in", {"f.csv": text.encode()}, split)


def test_many_files_in_blocks(spark, tmp_path):
    check(spark, tmp_path / "in", files(7, 6), 16)


def test_long_record_makes_its_file_unreadable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_files, "RECORD_CHARS", 50)
    (tmp_path / "a.csv").write_text('a,b\n1,"' + "line\n" * 20 + '"\n2,3\n')
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    got = csv_files.read_rows(spark, str(tmp_path)).collect()
    assert sorted((r.source[-5:], r.error) for r in got) == [
        ("a.csv", "record of more than 50 characters"), ("b.csv", None), ("b.csv", None)]


def test_outcomes_name_every_file(spark, tmp_path):
    for name, data in {"a.md": b"# T\ntext", "b.txt": b"x", "c.csv": b"\xff\xff\xff", "d.csv": b"a\n1\n"}.items():
        (tmp_path / name).write_bytes(data)
    listed = documents.list_files(spark, str(tmp_path))
    rows = documents.read_csv_rows(spark, str(tmp_path))
    pages = documents.read_markdown(spark, str(tmp_path))
    got = documents.load_outcomes(listed, pages, rows.select("source", "error")).collect()
    assert sorted((r.source[-5:], r.outcome, r.reason, r.docs_loaded) for r in got) == [
        ("/a.md", "loaded", None, 1), ("b.txt", "skipped", "no reader for suffix 'txt'", 0),
        ("c.csv", "failed", "unknown encoding", 0), ("d.csv", "skipped", "no reader for suffix 'csv'", 0)]
