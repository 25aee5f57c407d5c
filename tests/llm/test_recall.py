import duckdb
import numpy as np

from quillspark.llm import embedding_recall, queries

DATA = "/root/testdata/sf0.001"


def test_recall_on_planted_links(spark):
    got = {r["vec_id"]: r for r in queries.QUERIES["embedding_recall"](spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{DATA}/embeddings.parquet'").fetchall()
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    for k, share in enumerate(embedding_recall.SHARES):
        own = [n for n, i in enumerate(ids[: len(rows)]) if i % 10 == 0]
        ids += [ids[n] + (k + 1) * embedding_recall.STEP for n in own]
        x = np.vstack([x, x[own] + share * np.roll(x[own], -1, axis=1)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.9).sum(1) - 1
    want = {i: int(c) for i, c in zip(ids, n) if i % embedding_recall.STEP % 100 == 0}
    assert {i: r["n_true"] for i, r in got.items()} == want and sum(want.values()) > 20
    found = sum(min(r["n_links"], r["n_true"]) for r in got.values()) / sum(want.values())
    assert found >= 0.9 and all(r["n_links"] <= r["n_true"] for r in got.values())


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1), (100, [1.0, 0.1], 1), (200, None, 1), (300, [0.0, 0.0], 1), (400, [1.0], 1), (500, [None, 1.0], 1), (None, [1.0, 0.0], 1)], schema)
    got = {r["vec_id"]: (r["n_links"], r["n_true"]) for r in embedding_recall.recall(rows).collect()}
    # the row without an id lies beside both, but links with nothing
    assert set(got) >= {0, 100} and got[0][0] <= got[0][1] and 200 not in got and 300 not in got and 400 in got
    assert embedding_recall.recall(rows.where("false")).collect() == []


def test_queries_are_made_once(spark, monkeypatch):
    """Each block of queries reads the queries as they were written, not the whole table again."""
    seen = []
    monkeypatch.setattr(embedding_recall, "true_links", lambda rows, queries, least: seen.append((rows.inputFiles(), queries.inputFiles(), queries.count())) or queries.selectExpr("vec_id", "0L as n_true"))
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(301)], "vec_id long, embedding array<float>")
    embedding_recall.recall(rows)
    files, asked, n = seen[0]
    assert asked and all("/queries-" in f for f in asked) and not set(asked) & set(files) and n == 4 * 4
