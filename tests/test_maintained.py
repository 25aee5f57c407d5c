"""Results that are maintained as texts and rules change, and publishes that stop at each step."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markdown
from quillspark.operators import chunking, maintained, publish_flow
from quillspark.operators.manifests import Conflict, Log


def rule(texts):
    return markdown.clean(texts, "text").select("sha", F.col("markdown").alias("text"))


def cut(texts):
    return chunking.chunk_tree(texts, key="sha").select("sha", "title", "content")


def corpus(spark, path, clean=rule, name="clean-1"):
    return maintained.Corpus(spark, path, clean, cut, name, "chunks-1")


def arrive(spark, c, *rows):
    c.arrive(spark.createDataFrame(list(rows), "file_id long, kind string, text string"))


def states(c):
    return {r["file_id"]: (r["clean_state"], r["version"], r["text"]) for r in c.served().collect()}


def test_states(spark, tmp_path):
    c = corpus(spark, f"file://{tmp_path}")
    arrive(spark, c, (1, "converted", "## A\nbody  one"), (2, "converted", "## B\nbody  two"), (3, "converted", None), (4, "converted", "plain"))
    assert {s[:2] for s in states(c).values()} == {("raw", 1)}
    c.refresh()
    assert states(c) == {1: ("cleaned", 2, "## A\nbody one"), 2: ("cleaned", 2, "## B\nbody two"), 3: ("cleaned", 1, ""), 4: ("cleaned", 1, "plain")}
    # the same text again changes nothing; edits by hand stay through a forced cleaning, but for one of a cleaned text
    arrive(spark, c, (1, "converted", "## A\nbody  one"), (2, "raw_edit", "## B\nby  hand"), (4, "cleaned_edit", "by  hand"))
    c.refresh()
    assert states(c)[1] == ("cleaned", 2, "## A\nbody one") and states(c)[2] == ("edited", 3, "## B\nby  hand") and states(c)[4] == ("cleaned", 2, "by  hand")
    c.refresh(force=spark.createDataFrame([(2,), (4,)], "file_id long"))
    assert states(c)[2] == ("edited", 3, "## B\nby  hand") and states(c)[4] == ("cleaned", 3, "plain")
    # a new conversion ends the edit
    arrive(spark, c, (2, "converted", "## B\nnew  text"))
    c.refresh()
    assert states(c)[2] == ("cleaned", 5, "## B\nnew text")
    assert {(r["file_id"], r["content"]) for r in c.chunks().collect()} == {(1, "## A\nbody one"), (2, "## B\nnew text"), (4, "plain")}


def test_hashes_are_served_without_moving_texts(spark, tmp_path):
    c = corpus(spark, f"file://{tmp_path}")
    arrive(spark, c, (1, "converted", "## A\nbody  one"), (2, "converted", "## A\nbody  one"), (3, "converted", None), (4, "raw_edit", "by  hand"), (5, "converted", "## A\nbody one"))
    c.refresh()
    want = {r["file_id"]: (r["version"], r["h"]) for r in c.served().select("file_id", "version", F.sha2("text", 256).alias("h")).collect()}
    hashed = c.served(lambda x: F.sha2(x, 256))
    assert {r["file_id"]: (r["version"], r["text"]) for r in hashed.collect()} == want and len(want) == 5
    # the texts' hashes are taken in the scans' own stages, before any row moves
    taken = [x for x in hashed._jdf.queryExecution().sparkPlan().toString().split("\n") if "AS _own#" in x or "AS _made#" in x]
    assert len(taken) == 2 and all("sha2(" in x for x in taken)
    counts = {r["file_id"]: r["count"] for r in c.chunks().groupBy("file_id").count().collect()}
    assert {r["file_id"]: r["n"] for r in c.chunk_counts().collect()} == counts and 3 not in counts


def test_a_run_reads_what_changed(spark, tmp_path):
    """A hundredth of the texts changes: the second run's rules get those texts alone, from the folder they came in, and its
    rows are those of a run over everything."""
    seen = {"clean": [], "cut": []}

    def counted(kind, f):
        def run(texts):
            seen[kind].append((texts.count(), texts.inputFiles()))
            return f(texts)

        return run

    def make(path):
        return maintained.Corpus(spark, path, counted("clean", rule), counted("cut", cut), "clean-1", "chunks-1")

    old = [(i, "converted", f"## Title {i}\nbody  {i} of\nsome lines") for i in range(200)]
    new = [(i, "converted", f"## Title {i}\nanother  body") for i in (7, 107)]
    c = make(f"file://{tmp_path}/a")
    arrive(spark, c, *old)
    c.refresh()
    arrive(spark, c, *new, (8, "converted", old[8][2]))
    batch = c.log.read()["texts"][1]
    c.refresh()
    assert [n for n, _ in seen["clean"]] == [200, 2] and [n for n, _ in seen["cut"]] == [200, 2]
    read = [f for f in seen["clean"][1][1] if "/texts-" in f]
    assert read and all(batch in f for f in read)
    cleaned = c.log.read()["cleaned"]["clean-1"]
    assert all(cleaned[1] in f for f in c.read_for_chunks.inputFiles() if "/cleaned-" in f and cleaned[0] not in f)
    c.refresh()
    assert [n for n, _ in seen["clean"]] == [200, 2, 0]
    whole = make(f"file://{tmp_path}/b")
    arrive(spark, whole, *[new[0] if r[0] == 7 else new[1] if r[0] == 107 else r for r in old])
    whole.refresh()
    rows = lambda x: sorted((r["file_id"], r["text"]) for r in x.served().collect())
    parts = lambda x: sorted((r["file_id"], r["title"], r["content"]) for r in x.chunks().collect())
    assert rows(c) == rows(whole) and parts(c) == parts(whole)


def test_another_rule_computes_anew(spark, tmp_path):
    c = corpus(spark, f"file://{tmp_path}")
    arrive(spark, c, (1, "converted", "one  two"), (2, "raw_edit", "by  hand"), (3, "converted", "same"))
    c.refresh()
    loud = corpus(spark, f"file://{tmp_path}", lambda x: x.select("sha", F.upper("text").alias("text")), "loud-1")
    loud.refresh()
    assert states(loud) == {1: ("cleaned", 3, "ONE  TWO"), 2: ("edited", 1, "by  hand"), 3: ("cleaned", 2, "SAME")}


def test_one_number_has_one_writer(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}")
    first = log.read()
    assert log.commit(first | {"a": 1})["number"] == 1
    with pytest.raises(Conflict):
        log.commit(first | {"a": 2})
    assert log.read() == {"number": 1, "a": 1} and log.update(lambda m: m | {"b": m["a"] + 1})["b"] == 2
    assert log.read(1) == {"number": 1, "a": 1} and log.numbers() == [1, 2]


def published(spark, rows, old=()):
    """Parents and vectors of (file, parent, text): a vector a word."""
    p = spark.createDataFrame([("t", "k", i, f, x) for f, i, x in rows], "tenant_id string, kb_id string, parent_id string, file_id long, content string")
    words = p.select("*", F.posexplode(F.split("content", " ")).alias("chunk_index", "w"))
    v = words.select(F.concat_ws(":", "parent_id", "w").alias("vector_id"), "file_id", "tenant_id", "kb_id", "parent_id", "chunk_index", F.array(F.lit(1.0)).alias("embedding"))
    scopes = spark.createDataFrame([(f, "t", k) for f in {r[0] for r in rows} for k in ("k", *old)], "file_id long, tenant_id string, kb_id string")
    return p, v, scopes


def seen(base):
    parents = {r["parent_id"]: (r["status"], r["doc_version"], r["content"]) for r in base.parents().collect()}
    return parents, sorted((r["vector_id"], r["doc_version"]) for r in base.vectors().collect())


OLD = ({"a": ("active", 1, "x y"), "b": ("active", 1, "z"), "c": ("active", 1, "other")}, [("a:x", 1), ("a:y", 1), ("b:z", 1), ("c:other", 1)])
NEW = ({"a": ("active", 2, "x w"), "b": ("deleted", 1, "z"), "c": ("active", 1, "other"), "d": ("active", 1, "v")}, [("a:w", 2), ("a:x", 2), ("c:other", 1), ("d:v", 1)])


@pytest.mark.parametrize("step", [*publish_flow.BEFORE, "switched", "cleanup_pending", None])
def test_a_publish_that_stops(spark, tmp_path, step):
    """Readers see the old state or the new one; recovery ends the job, and what failed can be published again."""
    base = publish_flow.Base(spark, f"file://{tmp_path}")
    base.publish("one", *published(spark, [(1, "a", "x y"), (1, "b", "z"), (2, "c", "other")]))
    assert seen(base) == OLD and base.jobs()["one"]["state"] == "done"

    def stop(at):
        if at == step:
            raise publish_flow.Stopped(at)

    change = published(spark, [(1, "a", "x w"), (1, "d", "v")])
    if step is None:
        assert base.publish("two", *change, expected=3) == "done" and base.recover() == {}
    else:
        with pytest.raises(publish_flow.Stopped):
            base.publish("two", *change, stop=stop)
        after = step not in publish_flow.BEFORE
        parents, vectors = seen(base)
        assert parents["a"] == (NEW if after else OLD)[0]["a"] and (("a:w", 2) in vectors) == after
        again = publish_flow.Base(spark, f"file://{tmp_path}")  # another driver
        assert again.recover() == {"two": "done" if after else "failed"} and again.recover() == {}
        assert seen(again) == (NEW if after else OLD)
        if not after:
            again.publish("three", *change)
    assert seen(base) == NEW


def test_vectors_are_counted_before_the_switch(spark, tmp_path):
    base = publish_flow.Base(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="instead of 9"):
        base.publish("one", *published(spark, [(1, "a", "x y")]), expected=9)
    assert base.jobs()["one"]["state"] == "failed" and seen(base) == ({}, [])


def test_of_two_publishes_at_once_one_fails(spark, tmp_path):
    base = publish_flow.Base(spark, f"file://{tmp_path}")
    other = published(spark, [(2, "c", "other")])

    def stop(step):
        if step == "switching" and "two" not in base.jobs():
            base.publish("two", *other)

    with pytest.raises(Conflict):
        base.publish("one", *published(spark, [(1, "a", "x y")]), stop=stop)
    assert base.jobs()["one"]["state"] == "failed" and base.jobs()["two"]["state"] == "done"
    assert list(seen(base)[0]) == ["c"]


def test_a_clean_up_reaches_earlier_scopes(spark, tmp_path):
    """A file that moved leaves nothing where it was; what it publishes in the new place stays."""
    base = publish_flow.Base(spark, f"file://{tmp_path}")
    base.publish("one", *published(spark, [(1, "a", "x")]))
    p, v, _ = published(spark, [(1, "a", "x")])
    scopes = spark.createDataFrame([(1, "t", "k"), (1, "t", "new")], "file_id long, tenant_id string, kb_id string")
    base.publish("two", p.withColumn("kb_id", F.lit("new")), v.withColumn("kb_id", F.lit("new")), scopes)
    assert {(r["kb_id"], r["status"]) for r in base.parents().collect()} == {("k", "deleted"), ("new", "active")}
    assert [r["kb_id"] for r in base.vectors().collect()] == ["new"]
