"""Snapshots, files and streams."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dedup, snapshots, vectors
from quillspark.sources import files


def test_publish_and_swap(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = spark.range(5)
    assert snapshots.publish(rows, path, 5) == 1
    with pytest.raises(ValueError):
        snapshots.publish(spark.range(3), path, 4)
    assert snapshots.current(spark, path).count() == 5  # the failed snapshot isn't current
    assert snapshots.publish(spark.range(7), path, 7) == 2
    assert snapshots.current(spark, path).count() == 7


def test_flags_with_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "seq long, h string")
    assert {r["seq"] for r in dedup.keep_first(rows, ["h"], "seq").collect()} == {1, 3, 5}
    assert {r["seq"]: r["is_first"] for r in dedup.flag_first(rows, ["h"], "seq").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_children_without_parent_stay(spark):
    rows = spark.createDataFrame([(1, 1, None, "h"), (1, 2, None, "h"), (1, 3, "p", "h"), (1, 4, "p", "h"), (1, 5, "q", "h")], "file_id long, seq long, parent_id string, child_hash string")
    assert {r["seq"] for r in dedup.fresh_children(rows).collect()} == {1, 2, 3, 5}


def test_cosine_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: round(r["score"], 6) for r in vectors.top_k(v, [1.0, 0.0], 9).collect()}
    assert got == {1: 0.707107, 5: -1.0}


def test_deleted_vectors(spark):
    v = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (3, "a"), (None, "c")], "vec_id long, source string")
    ids = spark.createDataFrame([(3,), (3,), (None,)], "vec_id long")
    left = lambda *a, **k: sorted([tuple(r) for r in vectors.deleted(v, *a, **k).collect()], key=repr)
    assert left() == sorted([tuple(r) for r in v.collect()], key=repr)
    assert left(F.col("source") == "a") == [(2, None), (3, "b"), (None, "c")] and left(ids=ids) == [(1, "a"), (2, None), (None, "c")]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.md").write_text("  hello \n")
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "c.md").write_bytes(b"bad \xff byte")
    got = {r["path"].rpartition("/")[2]: r for r in files.uploads(spark, f"file://{tmp_path}").collect()}
    assert got["a.md"]["refused"] is None and got["b.exe"]["refused"] == "extension"
    assert got["a.md"]["stored_name"] == got["a.md"]["sha256"] + ".md"
    texts = {r["path"].rpartition("/")[2]: r["markdown"] for r in files.plain_texts(spark, f"file://{tmp_path}").collect()}
    assert texts["a.md"] == "hello\n" and texts["c.md"] == "bad � byte\n"
