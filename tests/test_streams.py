"""Streams in several batches: windows and answers that expire, uploads over restarts."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import limits, uploads


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def stream(spark, tmp_path, batches, schema, f, name):
    """The rows that ``f`` gives, a file a batch, and the numbers of state rows after each batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{n}")
    kind = spark.read.parquet(f"{tmp_path}/in-0").schema
    import os
    import shutil

    os.makedirs(f"{tmp_path}/in")
    q = f(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    sizes = []
    for n in range(len(batches)):
        for x in sorted(os.listdir(f"{tmp_path}/in-{n}")):
            if x.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/in-{n}/{x}", f"{tmp_path}/in/{n}-{x}")
        q.processAllAvailable()
        sizes.append(json.loads(q.lastProgress.json)["stateOperators"][0]["numRowsTotal"])
    q.stop()
    return spark.table(name).collect(), sizes


def test_anchored_windows(spark, tmp_path):
    batches = [[(1, s) for s in (50, 55)] + [(2, 50)], [(1, s) for s in (109, 110, 111)], [(3, 1000)], [(4, 5000)]]
    got, sizes = stream(spark, tmp_path, batches, "user_id long, s long", lambda e: limits.anchored_rates(e, "user_id", 2, 60), "anchored")
    # the window of user 1 starts at 50, so 109 is its third event and 110 starts anew
    assert {(r["user_id"], int(r["ts"].timestamp())): r["allowed"] for r in got} == {(1, 50): True, (1, 55): True, (2, 50): True, (1, 109): False, (1, 110): True, (1, 111): True, (3, 1000): True, (4, 5000): True}
    # windows that have ended leave nothing behind: the last batch holds its own key alone
    assert sizes[-1] <= sizes[0] / 2


def test_a_returning_key_starts_anew(spark, tmp_path):
    batches = [[("a", 10), ("a", 20), ("a", 30)], [("b", 500)], [("a", 501), ("a", 502)]]
    got, _ = stream(spark, tmp_path, batches, "ip string, s long", lambda e: limits.anchored_rates(e, "ip", 2, 60), "returning")
    assert sorted((int(r["ts"].timestamp()), r["allowed"]) for r in got if r["ip"] == "a") == [(10, True), (20, True), (30, False), (501, True), (502, True)]


def test_repeated_requests_get_the_first_answer(spark, tmp_path):
    batches = [[("k", "u", 10, "one"), ("k", "v", 11, "other")], [("k", "u", 50, "two"), ("k", "u", 51, None)], [("x", "u", 200, "far")], [("k", "u", 201, "three"), ("k", "u", 260, "four")]]
    got, sizes = stream(spark, tmp_path, batches, "scope string, key string, s long, answer string", lambda e: limits.idempotent(e, ["scope", "key"], "answer", 100), "answers")
    mine = sorted((int(r["ts"].timestamp()), r["fresh"], r["answer"]) for r in got if (r["scope"], r["key"]) == ("k", "u"))
    assert mine == [(10, True, "one"), (50, False, "one"), (51, False, "one"), (201, True, "three"), (260, False, "three")]
    assert sizes[2] < sizes[1] + sizes[0]


def test_idempotency(spark, tmp_path):
    got, _ = stream(spark, tmp_path, [[("a", 1), ("a", 100), ("b", 5)]], "key string, s long", lambda e: limits.first_of_each(e, ["key"]), "idempotent")
    assert sorted(r["key"] for r in got) == ["a", "b"]


def test_uploads_over_a_restart(spark, tmp_path):
    folder = tmp_path / "uploads"

    def put(place, content):
        (folder / place).parent.mkdir(parents=True, exist_ok=True)
        (folder / place).write_bytes(content)

    def run(name):
        files = uploads.judged(uploads.arriving(spark, f"file://{folder}"))
        q = files.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(uploads.OUT).parquet(f"{tmp_path}/out").collect()
        return {r["path"].split("/uploads/")[1]: (r["status"], r["first_path"] and r["first_path"].split("/uploads/")[1]) for r in rows}

    put("t/k/p/a.md", b"one")
    put("t/k/p/b.exe", b"program")
    put("t/k/q/a.md", b"one")  # another product: another scope
    first = run("first")
    assert first == {"t/k/p/a.md": (200, None), "t/k/p/b.exe": (400, None), "t/k/q/a.md": (200, None)}
    # another start from the checkpoint: the hash is known, but for a forced upload and another content
    put("t/k/p/again.md", b"one")
    put("t/k/p/force/again.md", b"one")
    put("t/k/p/c.md", b"two")
    assert run("second") == first | {"t/k/p/again.md": (409, "t/k/p/a.md"), "t/k/p/force/again.md": (200, "t/k/p/a.md"), "t/k/p/c.md": (200, None)}
