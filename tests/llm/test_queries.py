"""Every registered query of the numbered operators on the smallest tables, by its contract's columns and rows."""

import hashlib
import zlib

import duckdb
import pytest

from quillspark.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id held_out score predicted",
    "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_token_store": "doc_id start n_tokens ids_crc32",
    "op5_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_toxicity": "doc_id held_out score predicted neighbours cosines plain_cosines",
    "op7_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score perplexity",
    "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_embedding_graph": "vec_id n_links component_id kept",
    "op11_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_simplex_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_substrings": "doc_id n_words n_removed kept_sha256",
}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def found(spark):
    seen = {}

    def rows(name):
        if name not in seen:
            seen[name] = queries.QUERIES[name](spark, DATA).collect()
        return seen[name]

    return rows


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(found, texts, name):
    rows = found(name)
    assert set(COLUMNS[name].split()) <= set(rows[0].asDict())
    if name in ("op10_embedding_graph", "op12_simplex_clusters"):
        assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{DATA}/embeddings.parquet'").fetchall()[0][0]
    else:
        assert sorted({r["doc_id"] for r in rows}) == sorted(texts) and (name == "op8_packing" or len(rows) == len(texts))


@pytest.mark.parametrize("name, modulus, held", [("op1_quality", 3, 1), ("op6_toxicity", 5, 0), ("op7_language_model", 7, 2)])
def test_held_out(found, name, modulus, held):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in found(name))


def test_edited_texts(found, texts):
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in found("op2_fingerprints")}
    for i, nxt in zip(order, [*order[1:], order[0]]):
        t, n = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - n] + texts[nxt][:n]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_base_scores(found, texts):
    import math
    from collections import Counter

    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    counts = Counter(w for i, own in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in found("op7_language_model"):
        own = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in own), rel=1e-9)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_like_sql(found, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = c.execute(queries.ORACLES[name]).fetchall()
    assert sorted(tuple(r[k] for k in COLUMNS[name].split()) for r in found(name)) == sorted(want)
