"""The queries of the numbered operators, with the parameters they are meant to run with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents

BPE, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bottom_k import as_text, edited_fingerprints

    return edited_fingerprints(documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import KINDS, as_text, spans

    def of_kind(k: int):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [of_kind(k) for k in range(len(KINDS))]
    return spans(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, write_store

    return read_store(spark, write_store(documents(spark, sf_dir), public_tokenizers.path(BPE)), digests=True)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_pieces import encode_pieces

    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL), digests=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted", "neighbours", "cosines", "plain_cosines")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    return score(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path(BPE), with_ids=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op10_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_graph import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def embedding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_recall import recall

    return recall(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import cross_align

    return cross_align(documents(spark, sf_dir), public_tokenizers.path(BPE), public_tokenizers.path(PIECE_MODEL))


def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simplex_clusters import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeats

    return drop_repeats(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_fingerprints, op3_personal_data, op4_token_store, op5_sentencepiece, op6_toxicity, op7_language_model, op8_packing, op9_simhash, op10_embedding_graph,
        op11_alignment, op12_simplex_clusters, op13_substrings, embedding_recall,
    )
}
#: The definition of operator 10 over all pairs; the query finds links by its graphs.
_LINKS = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(a, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
SELECT m.vec_id, coalesce(k.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a) m
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = m.vec_id
"""
def _rounds(k: int = 16, dim: int = 64, rounds: int = 3) -> str:
    """The definition of operator 12: every centroid is compared in every round."""
    near = """a{r} AS (SELECT vec_id, v, j AS cluster, d AS distance FROM (
  SELECT e.*, c.j, list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d,
         row_number() OVER (PARTITION BY e.n ORDER BY d, c.j) AS place FROM e CROSS JOIN c{r} c) WHERE place = 1)"""
    means = """m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
  SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i),
c{s} AS (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{r} GROUP BY cluster) m ON m.cluster = c.j)"""
    steps = [step.format(r=r, s=r + 1) for r in range(rounds) for step in (near, means)] + [near.format(r=rounds)]
    return f"""
WITH e AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS j, v FROM e WHERE vec_id IS NOT NULL QUALIFY j < {k}),
{", ".join(steps)}
SELECT a.vec_id, a.cluster, a.distance::BIGINT AS distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.cluster"""


#: The definition of operator 13: every window is compared by its words.
_REPEATS = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS words FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS s FROM t)),
rep AS (SELECT r, s FROM win WHERE words IN (SELECT words FROM win GROUP BY words HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, s + unnest(generate_series(0, 34)) AS i FROM rep),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS rest FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""
ORACLES: dict[str, str] = {"op10_embedding_graph": _LINKS, "op12_simplex_clusters": _rounds(), "op13_substrings": _REPEATS}
