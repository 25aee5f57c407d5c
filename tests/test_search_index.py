"""Vector lists and postings against scans of everything."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import search_index, vectors
from quillspark.operators.search_index import Postings, VectorLists


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 8)) + 4 * r.normal(size=(12, 8))[np.arange(600) % 12]
    rows = [(i, [float(y) for y in v], i % 4 != 0) for i, v in enumerate(x)]
    odd = [(900, None, True), (901, [], True), (902, [0.0] * 8, True), (903, [1.0], True), (904, [1.0] * 7 + [float("nan")], True)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, is_current boolean").cache()


@pytest.fixture(scope="module")
def lists(table, tmp_path_factory):
    return VectorLists.build(table, f"file://{tmp_path_factory.mktemp('lists')}", lists=12)


def test_all_lists_are_exact(table, lists):
    for i in (0, 7, 300):
        q = table.where(f"vec_id = {i}").first()["embedding"]
        want = [(r["vec_id"], round(r["score"], 9)) for r in vectors.top_k(table.where("vec_id < 900"), q, 15, where=F.col("vec_id") % 3 == 0).collect()]
        assert [(r["vec_id"], round(r["score"], 9)) for r in lists.top_k(q, 15, 12, where=F.col("vec_id") % 3 == 0).collect()] == want
    assert lists.rows().count() == table.count() and lists.rows().where("list = -1").count() == 5
    assert lists.top_k([0.0] * 8, 5, 12).collect() == [] and lists.top_k([1.0], 5, 12).collect() == []


def test_a_search_reads_the_probed_lists(table, lists):
    q = table.where("vec_id = 5").first()["embedding"]
    near = lists.nearest_lists(q, 2)
    found = lists.top_k(q, 10, 2)
    parts = re.search(r"PartitionFilters: \[([^\]]*)\]", plan(found)).group(1)
    assert all(str(n) in parts for n in near) and {r["list"] for r in lists.rows().where(F.col("list").isin(near)).select("list").collect()} <= set(near)
    assert all(f"/list={n}/" not in f for f in found.inputFiles() for n in set(range(12)) - set(near)) or "isin" in parts.lower() or " IN " in parts
    exact = {r["vec_id"] for r in lists.top_k(q, 10, 12).collect()}
    assert len(exact & {r["vec_id"] for r in found.collect()}) >= 9  # the vectors lie in twelve clouds


def test_many_queries(table, lists):
    asked = table.where("vec_id % 100 = 0 and vec_id < 900").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    for probes in (2, 12):
        got = {}
        for r in lists.top_k_of_each(asked, 5, probes).collect():
            got.setdefault(r["query"], {})[r["place"]] = r["vec_id"]
        for r in asked.collect():
            rows = lists.rows().where(F.col("list").isin(lists.nearest_lists(r["q"], probes))).drop("is_current")
            want = [x["vec_id"] for x in vectors.top_k(rows, r["q"], 5).collect()]
            assert [got[r["query"]][p] for p in range(1, 6)] == want


def test_many_queries_meet_in_bounded_groups(spark, tmp_path, monkeypatch):
    """Copies fill a list; parts and blocks are small, pairs aren't rows, ties go to the lesser key, odd queries find nothing."""
    monkeypatch.setattr(search_index, "PART", 16)
    monkeypatch.setattr(search_index, "ASKED", 4)
    r = np.random.default_rng(5)
    x = np.vstack([np.repeat(r.normal(size=(1, 6)), 80, 0), r.normal(size=(60, 6))])
    table = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = VectorLists.build(table, f"file://{tmp_path}", lists=4)
    odd = [(500, [float("nan")] * 6), (501, None), (502, [0.0] * 6), (503, [1.0]), (504, [None] + [1.0] * 5), (505, [float("inf")] * 6)]
    asked = table.where("vec_id % 7 = 0").unionByName(spark.createDataFrame(odd, table.schema)).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    found = index.top_k_of_each(asked, 10, 4)
    assert "CoGroup" in plan(found) and "Generate" not in plan(found).split("CoGroup")[0]
    got = {}
    for row in found.orderBy("query", "place").collect():
        got.setdefault(row["query"], []).append(row["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: sorted(range(len(x)), key=lambda j: (-round(float(u[i] @ u[j]), 12), j))[:10] for i in range(0, len(x), 7)}
    assert got == want


def test_an_index_of_nothing(table, tmp_path):
    index = VectorLists.build(table.where("vec_id = 902"), f"file://{tmp_path}", lists=4)
    assert index.rows().count() == 1 and index.top_k([1.0] * 8, 3, 4).collect() == []


def pieces(text):
    out = []
    for run in re.findall(r"[㐀-䶿一-鿿豈-﫿]+|[^\W_㐀-䶿一-鿿豈-﫿]+", text.lower()):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if re.match(r"[㐀-鿿豈-﫿]{2}", run) else [run]
    return out


def test_terms(spark):
    texts = ["Plain words, 2 of them", "知识库检索", "中", "a中文b 知识", "", "__ -- !!", "Ünïcode ÉTÉ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(search_index.terms(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in rows] == [pieces(t) for t in texts]
    runs = spark.createDataFrame([(t,) for t in texts], "t string").select(search_index._runs(F.col("t")).alias("w")).collect()
    assert [[x for run in r["w"] for x in search_index._terms_of_run(run)] for r in runs] == [pieces(t) for t in texts]
    assert pieces("知识库检索") == ["知识", "识库", "库检", "检索"]


def brute(texts, query, k, k1=1.2, b=0.75):
    words = [(i, pieces(t or "")) for i, t in texts]
    mean = sum(len(w) for _, w in words) / len(words)
    scores = {}
    for t in sorted(set(pieces(query))):
        n = sum(t in w for _, w in words)
        for i, w in words:
            tf = Counter(w)[t]
            if tf:
                scores[i] = scores.get(i, 0) + math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
    return [(i, round(s, 9)) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    words = ["red", "green", "blue", "知识库", "检索系统", "知识", "common"]
    return [(i, " ".join(["common"] * r.randint(0, 2) + [r.choice(words) for _ in range(r.randint(0, 12))])) for i in range(300)] + [(300, None), (301, "!!")]


def test_ranking_is_that_of_a_scan(spark, texts, tmp_path, monkeypatch):
    """Small blocks, so that bounds leave most of them unread."""
    monkeypatch.setattr(search_index, "BLOCK_DOCS", 8)
    index = Postings.build(spark.createDataFrame(texts, "doc_id long, text string"), f"file://{tmp_path}")
    for query in ("red", "common green", "知识库 blue", "检索", "absent", "", "RED red, Red"):
        for k in (1, 5, 400):
            got = [(r["doc_id"], round(r["score"], 9)) for r in index.top_k(query, k, first=3).collect()]
            assert got == brute(texts, query, k), (query, k)


def test_blocks_are_made_in_one_pass(spark, texts, tmp_path, monkeypatch):
    """Blocks bounded by documents and by bytes, from rows where they lie; repeated and null ids are documents of their own."""
    monkeypatch.setattr(search_index, "BLOCK_DOCS", 16)
    monkeypatch.setattr(search_index, "BLOCK_BYTES", 400)
    rows = [*texts, (7, "red red green"), (7, "red red green"), (None, "知识库 red"), (400, "red " * 500)]
    index = Postings.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}")
    held = index._of(["common", "red"]).select("block", F.explode("docs").alias("d")).groupBy("block").agg(F.countDistinct("d.at").alias("n")).collect()
    assert len(held) >= 18 and max(r["n"] for r in held) <= 16
    for query in ("red", "common 知识库"):
        want = brute([(n, t) for n, (_, t) in enumerate(rows)], query, 500)
        want = sorted(((s, -1 if rows[n][0] is None else rows[n][0]) for n, s in want), key=lambda x: (-x[0], x[1]))
        assert [(round(r["score"], 9), -1 if r["doc_id"] is None else r["doc_id"]) for r in index.top_k(query, 500, first=2).collect()] == want


def test_a_search_reads_no_text(spark, texts, tmp_path):
    index = Postings.build(spark.createDataFrame(texts, "doc_id long, text string"), f"file://{tmp_path}")
    found = plan(index.top_k("red blue", 5))
    assert "text" not in found.replace("Text", "") and "PartitionFilters: [isnotnull(bucket" in found or " IN " in found
    assert not re.search(r"ReadSchema: struct<[^>]*text", found)


def test_an_index_of_no_texts(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Postings.build(empty, f"file://{tmp_path}").top_k("red", 3).collect() == []
