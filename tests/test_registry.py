"""Edits of files, dependents, claims and the audit trail on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import registry
from quillspark.operators.manifests import Conflict

FILES = "id long, status string, category string, product_id string, tenant_id string, kb_id string, previous_tenant_id string, previous_kb_id string"
EDITS = "id long, category string, product_id string, tenant_id string, kb_id string"


def rows(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def test_the_first_scope_left_is_remembered(spark):
    files = spark.createDataFrame([(1, "done", None, None, "t", "k", None, None), (2, "failed", None, None, "t", "k", "", None), (3, "done", "c", None, "t", "k", None, None)], FILES)
    edit = lambda f, *e: registry.edit_meta(f, spark.createDataFrame(list(e), EDITS))
    once = edit(files, (1, None, None, "u", None), (2, None, None, None, "l"), (3, "c", None, "t", None), (9, "x", None, None, None))
    assert rows(once) == {1: ("chunked", None, None, "u", "k", "t", "k"), 2: ("failed", None, None, "t", "l", "t", "k"), 3: ("done", "c", None, "t", "k", None, None)}
    twice = edit(once, (1, "guide", None, "v", "m"))
    assert rows(twice)[1] == ("chunked", "guide", None, "v", "m", "t", "k")
    cleared = registry.clear_previous(twice, spark.createDataFrame([(1,)], "id long"))
    assert rows(cleared)[1][-2:] == (None, None) and rows(cleared)[2][-2:] == ("t", "k")


def test_dependents_of_an_edit(spark):
    chunks = spark.createDataFrame([(1, "t", "k", "h", False), (2, "t", "k", "h", True), (3, "t", "x", "h", True), (4, "t", "k", "g", True), (2, "t", "k", "own", False)], "file_id long, tenant_id string, kb_id string, parent_hash string, deduplicated boolean")
    files = spark.createDataFrame([(i, "done", None, None, "t", "k", None, None) for i in (1, 2, 3, 4)], FILES)
    one = spark.createDataFrame([(1,)], "file_id long")
    assert {i: r[0] for i, r in rows(registry.after_edits(files, chunks, one)).items()} == {1: "converted", 2: "chunked", 3: "done", 4: "done"}
    left, parents = registry.delete_files(files, chunks, one)
    assert {i: r[0] for i, r in rows(left).items()} == {2: "chunked", 3: "done", 4: "done"} and parents.count() == 4
    both = spark.createDataFrame([(1,), (2,)], "file_id long")
    assert set(rows(registry.delete_files(files, chunks, both)[0])) == {3, 4}


def test_claims(spark, tmp_path):
    c = registry.Claims(spark, f"file://{tmp_path}")
    assert c.claim("a", ["p1", "p2", "p1"]) == ["p1", "p2"] and c.claim("b", ["p2", "p3"]) == ["p3"] and c.claim("a", ["p1"]) == ["p1"]
    c.release("b", ["p1", "p3"])
    assert c.held() == {"p1": "a", "p2": "a"}
    # both read the same state; the one that comes second looks again and finds the page taken
    other, read, first = registry.Claims(spark, f"file://{tmp_path}"), c.log.read, []

    def race(number=None):
        m = read(number)
        if not first:
            first.append(other.claim("b", ["p4"]))
        return m

    c.log.read = race
    assert c.claim("a", ["p4"]) == [] and first == [["p4"]] and other.held()["p4"] == "b"


def test_audit_trail(spark, tmp_path):
    path = f"file://{tmp_path}/trail"
    at = lambda day, hour: datetime.datetime(2024, 5, day, hour)
    for day in (1, 2):
        made = spark.createDataFrame([(at(day, h), "ann", "page.publish", "page", h, {"revision": str(h)}) for h in (1, 2)], "at timestamp, actor string, action string, target_type string, target_id int, detail map<string, string>")
        registry.append_audit(made, path)
    got = registry.audit(spark, path, size=3).collect()
    assert [(r["at"], r["target_id"], r["detail"]) for r in got] == [(at(2, 2), "2", '{"revision":"2"}'), (at(2, 1), "1", '{"revision":"1"}'), (at(1, 2), "2", '{"revision":"2"}')]
    late = registry.audit(spark, path, since=F.lit("2024-05-02").cast("date"), actor="ann", target_id="1")
    assert late.count() == 1 and "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().executedPlan().toString()


def test_names_of_sources(spark):
    vectors = spark.createDataFrame([(i, [1.0], s) for i, s in enumerate(["1", "2", "gone", None, "1"])], "vec_id long, embedding array<double>, source string")
    files = spark.createDataFrame([(1, "A guide.md"), (2, "b.md")], "id long, name string")
    page = lambda name: [(r["vec_id"], r["source_name"], r["total"]) for r in registry.documents_by_name(vectors, files, name, 1, 9, "vec_id").collect()]
    assert page("") == [(0, "A guide.md", 5), (1, "b.md", 5), (2, "gone", 5), (3, None, 5), (4, "A guide.md", 5)]
    assert page("GUIDE") == [(0, "A guide.md", 2), (4, "A guide.md", 2)] and page("%") == []


def test_a_claim_gives_up_at_last(spark, tmp_path):
    c = registry.Claims(spark, f"file://{tmp_path}")
    stale = c.log.read()
    c.claim("a", ["x"])
    c.log.read = lambda number=None: stale
    with pytest.raises(Conflict):
        c.claim("b", ["y"])
