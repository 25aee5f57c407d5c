"""Trash and restores, differences of lines, name-based ids."""

import random
import uuid

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import wiki


def pages(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long, deleted_by string")


def test_a_restore_brings_back_what_its_deletion_took(spark):
    #      1
    #    2   3
    #  4  5     (5 was deleted before 2)
    #  6
    tree = pages(spark, [(1, None, None), (2, 1, None), (3, 1, None), (4, 2, None), (5, 2, None), (6, 4, None)])
    first = wiki.trashed(tree, F.col("id") == 5, "a")
    second = wiki.trashed(first, F.col("id") == 2, "b")
    marks = {r["id"]: r["deleted_by"] for r in second.collect()}
    assert marks == {1: None, 2: "b:2", 3: None, 4: "b:2", 5: "a:5", 6: "b:2"}
    back = wiki.restored(second, spark.createDataFrame([("b:2",)], "deleted_by string"))
    assert {r["id"]: (r["parent_id"], r["deleted_by"]) for r in back.collect()} == {1: (None, None), 2: (1, None), 3: (1, None), 4: (2, None), 5: (2, "a:5"), 6: (4, None)}


def test_what_comes_back_below_the_trash_hangs_higher(spark):
    tree = pages(spark, [(1, None, None), (2, 1, None), (3, 2, None), (4, 3, None), (5, None, None), (6, 5, None)])
    gone = wiki.trashed(tree, F.col("id").isin(4, 6), "a")
    gone = wiki.trashed(gone, F.col("id").isin(2, 5), "b")
    back = wiki.restored(gone, spark.createDataFrame([("a:4",), ("a:6",), ("none",)], "deleted_by string"))
    got = {r["id"]: (r["parent_id"], r["deleted_by"]) for r in back.collect()}
    assert got == {1: (None, None), 2: (1, "b:2"), 3: (2, "b:2"), 4: (1, None), 5: (None, "b:5"), 6: (None, None)}


def test_nested_roots_of_one_deletion(spark):
    chain = pages(spark, [(i, i - 1 if i else None, None) for i in range(40)])
    got = {r["id"]: r["deleted_by"] for r in wiki.trashed(chain, F.col("id").isin(7, 20, 33), "x").collect()}
    assert got == {i: "x:7" if i >= 7 else None for i in range(40)}
    assert wiki.trashed(chain, F.col("id") < 0, "x").where("deleted_by is not null").count() == 0
    assert wiki.restored(chain.where("false"), chain.select("deleted_by")).collect() == []


def test_newest_revisions(spark):
    rows = spark.createDataFrame([(p, r, f"{p}-{r}") for p in (1, 2) for r in range(p * 3)] + [(1, 2, "again")], "page_id long, revision_id long, content_md string")
    got = sorted((r["page_id"], r["revision_id"], r["content_md"]) for r in wiki.newest_revisions(rows, 2).collect())
    assert got == [(1, 1, "1-1"), (1, 2, "1-2"), (1, 2, "again"), (2, 4, "2-4"), (2, 5, "2-5")]


def test_line_diff(spark):
    rows = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, "n"), ("same", "same"), ("gone", ""), ("", None)], "a string, b string")
    got = [[(x["op"], x["text"]) for x in r["d"]] for r in rows.select(wiki.line_diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [[("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c"), ("insert", "d")], [("insert", "n")], [("equal", "same")], [("delete", "gone")], []]


def test_name_ids(spark):
    r = random.Random(1)
    names = ["", "é 中文 🙂", "a|b|c"] + ["".join(chr(r.randint(32, 1000)) for _ in range(r.randint(0, 60))) for _ in range(1000)]
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string").select("n", text.name_id(str(uuid.NAMESPACE_OID), F.col("n")).alias("id"))
    assert "ython" not in rows._jdf.queryExecution().executedPlan().toString()
    for row in rows.collect():
        assert row["id"] == (None if row["n"] is None else uuid.uuid5(uuid.NAMESPACE_OID, row["n"]).hex)


def test_parent_names(spark):
    rows = spark.createDataFrame([("t", "k", " A  Title ", "Some\n text"), ("t", "k", "a title", "some text"), ("t", "k", None, None)], "t string, k string, title string, c string")
    names = [r[0] for r in rows.select(text.parent_name(*[F.col(c) for c in rows.columns])).collect()]
    assert names[0] == names[1] != names[2] and names[0].startswith("t|k|a title|")
