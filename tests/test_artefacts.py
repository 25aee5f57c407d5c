"""Images and layouts as files, and copies into another schema that stop half way."""

import base64
import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import migration
from quillspark.sources import artefacts


def uri(data, head="data:image/png;base64"):
    return f"{head},{base64.b64encode(data).decode()}"


def test_images(spark, tmp_path):
    docs = spark.createDataFrame(
        [
            (1, "a ![one](images/a.png) and ![](images/b.JPG), ![x](images/gone.png) [no](images/a.png) images/a.png", {"a.png": uri(b"one"), "b.JPG": uri(b"two")}),
            (2, "![same](images/c.png)![up](images/../up.png)", {"c.png": uri(b"one"), "../up.png": uri(b"bad"), "": uri(b"none")}),
            (3, "![p](images/p.png) ![q](images/q.png) ![r](images/r.png)", {"p.png": "data:image/png,plain", "q.png": "data:image/png;base64,", "r.png": "data:image/png;base64,@@@"}),
            (4, "no images", None), (5, None, {"z.png": uri(b"three")}), (6, "![e](images/e.png)", {}),
        ],
        "doc_id long, markdown string, images map<string, string>",
    )
    got = {r["doc_id"]: r for r in artefacts.with_images(docs, f"file://{tmp_path}/images").collect()}
    one, two, three = (hashlib.sha256(x).hexdigest() for x in (b"one", b"two", b"three"))
    assert got[1]["markdown"] == f"a ![one](/media/images/{one}.png) and ![](/media/images/{two}.jpg), ![x](images/gone.png) [no](images/a.png) images/a.png"
    assert got[2]["markdown"] == f"![same](/media/images/{one}.png)![up](images/../up.png)"
    assert got[3]["markdown"] == "![p](images/p.png) ![q](images/q.png) ![r](images/r.png)"
    assert got[4]["markdown"] == "no images" and got[5]["markdown"] is None and got[6]["markdown"] == "![e](images/e.png)"
    assert [(i["alt"], i["ref"]) for i in got[2]["image_list"]] == [("same", f"/media/images/{one}.png"), ("up", "images/../up.png")]
    files = {f: open(tmp_path / "images" / f, "rb").read() for f in os.listdir(tmp_path / "images") if not f.startswith(("_", "."))}
    assert files == {f"{one}.png": b"one", f"{two}.jpg": b"two", f"{three}.png": b"three"} and not os.path.exists(tmp_path / "up.png")


def test_a_failed_write_is_referred_to_nowhere(spark, tmp_path):
    """One task fails after others wrote their files: there is no table of them, and another run ends whole."""
    rows = spark.range(40).select(F.concat("id", F.lit(".txt")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content")).repartition(4)
    long = rows.withColumn("name", F.when(F.col("name") == "17.txt", F.repeat(F.lit("x"), 300)).otherwise(F.col("name")))
    with pytest.raises(Exception, match="name too long"):
        artefacts.write_files(long, f"file://{tmp_path}/f")
    assert not [f for f in os.listdir(tmp_path / "f") if f.startswith("_written") and os.path.exists(tmp_path / "f" / f / "_SUCCESS")]
    done = artefacts.write_files(rows, f"file://{tmp_path}/f").collect()
    assert len(done) == 40 and all(open(r["path"].removeprefix("file://"), "rb").read().decode() + ".txt" == r["name"] for r in done)


def test_layouts(spark, tmp_path):
    docs = spark.createDataFrame([("k1", "[1]", '{"a": "é"}'), ("k2", None, None), ("../k3", "[]", None)], "doc_id string, content_list string, middle_json string")
    got = {(r["doc_id"], r["part"]): r["path"] for r in artefacts.write_layouts(docs, f"file://{tmp_path}/l").collect()}
    assert set(got) == {("k1", "content_list"), ("k1", "middle_json")}
    assert open(got["k1", "middle_json"].removeprefix("file://"), encoding="utf-8").read() == '{"a": "é"}'


OLD = "id string, tenant_id string, kb_id string, content string, parent_title string, parent_content string"


def old_rows(spark, n=200):
    rows = [(f"r{i:04d}", "t" if i % 5 else None, "k", f"text {i}", f"Title {i % 9}", f"body {i % 9}") for i in range(n)] + [(None, "t", "k", "no id", None, None)]
    return spark.createDataFrame(rows, OLD)


def test_a_copy_goes_on_where_it_stopped(spark, tmp_path):
    rows, known = old_rows(spark), spark.createDataFrame([("r0003", "own"), ("r0004", "")], "id string, parent_id string")
    change, asked = migration.with_parents(str(uuid.NAMESPACE_URL), known), []

    def run(last):
        def stop(page):
            if page == last:
                raise InterruptedError
            asked.append(page)

        return migration.Migration(spark, f"file://{tmp_path}/m").copy(rows, "id", change, 5, stop)

    for last in (1, 3):
        with pytest.raises(InterruptedError):
            run(last)
        with pytest.raises(ValueError):
            migration.Migration(spark, f"file://{tmp_path}/m").swap(201, "old")
    run(None)
    assert asked == [0, 1, 2, 3, 4]  # no page twice
    m = migration.Migration(spark, f"file://{tmp_path}/m")
    with pytest.raises(ValueError, match="isn't current"):
        m.rows()
    assert m.swap(201, "old")["backup"] == "old"
    got = m.rows().collect()
    assert sorted(str(r["id"]) for r in got) == sorted([*(f"r{i:04d}" for i in range(200)), "None"])
    by_id = {r["id"]: r for r in got}
    assert by_id["r0003"]["parent_id"] == "own" and by_id["r0005"]["tenant_id"] == "default" and by_id["r0006"]["doc_version"] == 1
    name = "t|k|title 4|" + hashlib.sha256(b"body 4").hexdigest()
    assert by_id["r0004"]["parent_id"] == uuid.uuid5(uuid.NAMESPACE_URL, name).hex == by_id["r0013"]["parent_id"]
    parents = migration.parents_of(rows, str(uuid.NAMESPACE_URL), known)
    assert {r["parent_id"] for r in parents.where("tenant_id = 't'").collect()} >= {"own", by_id["r0004"]["parent_id"]}
    assert parents.count() == parents.select("tenant_id", "kb_id", "parent_id").distinct().count()


def test_a_page_is_counted_before_it_counts(spark, tmp_path):
    m = migration.Migration(spark, f"file://{tmp_path}/m")
    with pytest.raises(ValueError, match="instead of"):
        m.copy(old_rows(spark), "id", lambda rows: rows.where("content <> 'text 7'"), 3)
    assert m.log.read()["pages"] == {}


def test_an_empty_table(spark, tmp_path):
    m = migration.Migration(spark, f"file://{tmp_path}/m")
    m.copy(old_rows(spark).where("false"), "id", lambda rows: rows, 3)
    m.swap(0, "old")
    assert m.rows().count() == 0
