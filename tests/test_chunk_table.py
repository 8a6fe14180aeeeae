"""Chunk table in buckets: what changes is rewritten, what does not keeps its files."""

import random

import pytest
from pyspark.sql import functions as F

from rotorsight.sources import chunk_table as T, snapshots

KIND = "chunk_id string, text string, path array<string>, page int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, ["a", t or ""], p) for i, t, p in rows], KIND).repartition(3)


def rows_of(n, text="text"):
    return [(f"id{i}", f"{text} {i}", i if i % 3 else None) for i in range(n)]


def content(df):
    return sorted(((r.chunk_id, r.text, r.page) for r in df.collect()), key=str)


def data_files(root):
    return {str(p) for p in root.glob("data/**/*.parquet")}


def test_unchanged_builds_write_nothing(spark, tmp_path):
    root = tmp_path / "t"
    build = table(spark, rows_of(200))
    assert T.rebuild(build, str(root)) == 1
    before, digest = data_files(root), T.table_digest(spark, str(root))
    assert T.rebuild(build.repartition(7), str(root)) == 1
    assert T.upsert(build.filter("page > 50"), str(root)) == 1
    assert T.upsert(build.limit(0), str(root)) == 1
    assert data_files(root) == before and T.table_digest(spark, str(root)) == digest
    assert content(T.read(spark, str(root))) == sorted(rows_of(200), key=str)


def test_an_upsert_rewrites_only_buckets_that_change(spark, tmp_path):
    root = tmp_path / "t"
    T.upsert(table(spark, rows_of(300)), str(root))
    before = T.manifest(spark, str(root)).collect()
    part = rows_of(20) + [("id7", "new text", 1), ("fresh", "x", None)]
    part = [r for r in part if r != ("id7", "text 7", 7)]
    assert T.upsert(table(spark, part), str(root)) == 2
    want = {r[0]: r for r in rows_of(300)} | {r[0]: r for r in part}
    assert content(T.read(spark, str(root))) == sorted(want.values(), key=str)
    changed = T.changed_buckets(spark, str(root), 1, 2)
    assert 1 <= len(changed) <= 2
    after = {r.bucket: r.folder for r in T.manifest(spark, str(root)).collect()}
    assert {r.bucket for r in before if after[r.bucket] != r.folder} <= set(changed)
    assert content(T.read(spark, str(root), 1)) == sorted(rows_of(300), key=str)


def test_random_upserts_equal_a_dictionary(spark, tmp_path):
    rng, root, want = random.Random(1), str(tmp_path / "t"), {}
    for step in range(5):
        part = {f"k{rng.randint(0, 60)}" if rng.random() < .95 else None:
                rng.choice(["", None, "a", "b", "é" * 50]) for _ in range(rng.randint(0, 25))}
        T.upsert(table(spark, [(k, t, None) for k, t in part.items()]), root, buckets=7)
        want |= part
        if want:
            assert content(T.read(spark, root)) == sorted(
                ((k, t, None) for k, t in want.items()), key=str)
    full = table(spark, [(k, t, None) for k, t in want.items()])
    assert T.rebuild(full, root) == snapshots.current(spark, root)
    other = str(tmp_path / "other")
    T.rebuild(full, other, buckets=7)
    assert T.table_digest(spark, other) == T.table_digest(spark, root)


def test_rebuild_drops_what_is_gone(spark, tmp_path):
    root = str(tmp_path / "t")
    T.rebuild(table(spark, rows_of(100)), root)
    assert T.rebuild(table(spark, rows_of(3)), root) == 2
    assert content(T.read(spark, root)) == sorted(rows_of(3), key=str)
    assert T.manifest(spark, root).count() <= 3
    with pytest.raises(ValueError, match="without chunks"):
        T.rebuild(table(spark, []), root)
    assert T.read(spark, root).count() == 3


def test_copies_other_columns_and_any_change(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [("a", "x", 1), ("a", "y", 1), ("a", "x", 1), (None, None, None)]
    T.upsert(table(spark, rows), root)
    first = content(T.read(spark, root))
    assert len(first) == 2
    assert T.upsert(table(spark, rows[::-1]), root) == 1, "the copy kept does not depend on order"
    with pytest.raises(ValueError, match="columns differ"):
        T.upsert(table(spark, rows).drop("page"), root)
    digest = T.table_digest(spark, root)
    for change in ({"text": F.lit("z")}, {"page": F.lit(5)}, {"path": F.array(F.lit("q"))}):
        other = str(tmp_path / f"o{next(iter(change))}")
        T.upsert(table(spark, rows).withColumns(change), other)
        assert T.table_digest(spark, other) != digest


def test_a_crash_or_a_second_writer_leaves_whole_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    T.upsert(table(spark, rows_of(50)), root)
    for step in ("_write", "_publish"):
        with monkeypatch.context() as patch:
            patch.setattr(T, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                T.upsert(table(spark, rows_of(50, "other")), root)
        assert content(T.read(spark, root)) == sorted(rows_of(50), key=str)
    with monkeypatch.context() as patch:
        real = T._write

        def overtaken(*args):
            patch.setattr(T, "_write", real)
            T.upsert(table(spark, [("id1", "first writer", 0)]), root)
            return real(*args)

        patch.setattr(T, "_write", overtaken)
        with pytest.raises(snapshots.SnapshotConflict):
            T.upsert(table(spark, [("id2", "second writer", 0)]), root)
    texts = {r.text for r in T.read(spark, root).collect()}
    assert "first writer" in texts and "second writer" not in texts
