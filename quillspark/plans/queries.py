"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import html, markdown, text
from ..functions.predicates import all_of, below, differs, equals, starts_with
from ..operators import chunking, dedup, headings, listing, maintained, migration, publish_flow, publishing, registry, search_index, snapshots, vectors, wiki
from ..streaming import limits
from . import tables as t
from .lineage import scratch, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The derived tables of plans/tables.py for the other side.
FILES = "files AS (SELECT d.doc_id AS id, 'doc-' || (d.doc_id % 500) || '.md' AS name, lang AS tenant_id, source AS kb_id, sha256(text) AS sha256, CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' ELSE 'chunked' END AS status, d.doc_id * 7919 % 100000 AS created_at, n_chars AS size FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
PARENTS = r"parents AS (SELECT doc_id AS file_id, doc_id AS seq, lang AS tenant_id, source AS kb_id, sha256(regexp_replace(lower(text), '\s+', '', 'g')) AS parent_hash FROM documents)"
CHUNKS = r"lines AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), chunks AS (SELECT file_id, file_id * 100000 + i AS seq, CASE WHEN i % 11 <> 10 THEN file_id || '-' || (i // 4) END AS parent_id, i AS chunk_index, content, sha256(regexp_replace(lower(content), '\s+', '', 'g')) AS child_hash FROM lines)"
PAGES = "pages AS (SELECT conv_id AS page_id, 'page ' || (conv_id % 40) AS title, 'p-' || conv_id AS slug, conv_id % 8 AS space_id, CASE WHEN conv_id % 3 = 0 THEN 'draft' ELSE 'published' END AS status, CASE WHEN conv_id % 10 = 0 THEN conv_id END AS deleted_at, max(turn) - conv_id % 2 AS current_revision_id FROM conversations GROUP BY conv_id)"
REVISIONS = "revisions AS (SELECT conv_id AS page_id, turn AS revision_id, text || ' [[page ' || ((conv_id * 7 + turn) % 60) || ']] [[ p-' || (conv_id + 1) || ' ]]' AS content_md FROM conversations)"
STORE = "store AS (SELECT p_brand AS tenant_id, p_type AS kb_id, p_partkey AS parent_id, p_name AS content, sha256(p_name) AS content_sha256, CASE WHEN p_partkey % 9 = 0 THEN 'deleted' ELSE 'active' END AS status, CAST(p_size AS BIGINT) AS doc_version, p_partkey % 21 = 0 AS deduplicated FROM part)"
UPDATES = "raw_updates AS (SELECT tenant_id, kb_id, parent_id, CASE WHEN parent_id % 6 = 0 THEN content || ' revised' ELSE content END AS content, deduplicated FROM store WHERE parent_id % 3 = 0 UNION ALL SELECT tenant_id, kb_id, parent_id + 1000000, content, deduplicated FROM store WHERE parent_id % 50 = 0), updates AS (SELECT *, sha256(content) AS content_sha256, 'active' AS status FROM raw_updates)"
PVECTORS = "pv0 AS (SELECT tenant_id, CASE WHEN parent_id % 11 = 0 THEN 'moved' ELSE kb_id END AS kb_id, parent_id, doc_version - CASE WHEN parent_id % 5 = 0 THEN 1 ELSE 0 END AS doc_version FROM store WHERE parent_id % 7 <> 0 UNION ALL SELECT tenant_id, kb_id, parent_id + 2000000, doc_version FROM store WHERE parent_id % 13 = 0), pvectors AS (SELECT *, parent_id % 1000000 AS file_id, parent_id || ':' || doc_version AS vector_id, parent_id % 19 <> 0 AS is_current FROM pv0)"
TREE = "tree AS (SELECT c_custkey AS id, CASE WHEN c_custkey // 3 > 0 THEN c_custkey // 3 END AS parent_id, c_custkey % 17 = 0 AS mark FROM customer)"
LINKS = "latest AS (SELECT page_id, arg_max(content_md, revision_id) AS content_md FROM revisions GROUP BY page_id), found AS (SELECT DISTINCT l.page_id, p.space_id, trim(unnest(regexp_extract_all(content_md, '\\[\\[([^\\[\\]]+)\\]\\]', 1))) AS target FROM latest l JOIN pages p ON l.page_id = p.page_id), links AS (SELECT f.page_id, f.target, coalesce((SELECT min(p.page_id) FROM pages p WHERE p.space_id = f.space_id AND p.title = f.target), (SELECT min(p.page_id) FROM pages p WHERE p.space_id = f.space_id AND p.slug = f.target)) AS to_page FROM found f)"


def query(sql: str | None = None, *ctes: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            body = sql.replace("RECURSIVE", "")
            ORACLES[f.__name__] = (f"WITH {recursive}" + ", ".join(ctes) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+") if ctes or recursive else body)
        return f

    return add


@query(r"SELECT source, count(*) AS n_documents, count(DISTINCT sha256(regexp_replace(lower(text), '\s+', '', 'g')) ) AS n_kept, count(*) - count(DISTINCT sha256(regexp_replace(lower(text), '\s+', '', 'g'))) AS n_skipped FROM documents GROUP BY source")
def dup_by_source(spark, d):
    """Documents of each source, and how many a keep-first deduplication keeps."""
    rows = dedup.flag_first(t.parents(spark, d), ["kb_id", "parent_hash"], "seq")
    return rows.groupBy(F.col("kb_id").alias("source")).agg(F.count("*").alias("n_documents"), F.sum(F.col("is_first").cast("long")).alias("n_kept"), F.sum((~F.col("is_first")).cast("long")).alias("n_skipped"))


@query("SELECT file_id, parent_hash FROM parents", PARENTS)
def doc_fingerprint(spark, d):
    return t.parents(spark, d).select("file_id", "parent_hash")


@query("SELECT min(file_id) AS file_id, parent_hash FROM parents GROUP BY parent_hash", PARENTS)
def doc_keep_first(spark, d):
    return dedup.keep_first(t.parents(spark, d), ["parent_hash"], "seq").select("file_id", "parent_hash")


SERVED = "served AS (SELECT p.* FROM parents p JOIN files f ON p.file_id = f.id WHERE f.status = 'done')"


def _served(spark, d):
    done = t.files(spark, d).where("status = 'done'").select("id")
    p = t.parents(spark, d)
    return p.join(done, p["file_id"] == done["id"], "left_semi").withColumnRenamed("file_id", "owner")


@query("SELECT p.file_id, p.parent_hash FROM parents p WHERE EXISTS (SELECT 1 FROM served s WHERE s.tenant_id = p.tenant_id AND s.kb_id = p.kb_id AND s.parent_hash = p.parent_hash AND s.file_id <> p.file_id)", PARENTS, FILES, SERVED)
def cross_scope_dedup(spark, d):
    """Parents that another finished file of their scope serves."""
    return dedup.served_elsewhere(t.parents(spark, d), _served(spark, d)).select("file_id", "parent_hash")


@query("SELECT p.file_id FROM parents p WHERE NOT EXISTS (SELECT 1 FROM served s WHERE s.tenant_id = p.tenant_id AND s.kb_id = p.kb_id AND s.parent_hash = p.parent_hash AND s.file_id <> p.file_id)", PARENTS, FILES, SERVED)
def fresh_parents(spark, d):
    return dedup.fresh_parents(t.parents(spark, d), _served(spark, d)).select("file_id")


@query("SELECT min(seq) AS seq, child_hash FROM chunks GROUP BY file_id, coalesce(parent_id, 'row:' || seq), child_hash", CHUNKS)
def intra_parent_dedup(spark, d):
    return dedup.fresh_children(t.chunks(spark, d)).select("seq", "child_hash")


@query("SELECT DISTINCT b.file_id FROM parents a JOIN parents b ON a.tenant_id = b.tenant_id AND a.kb_id = b.kb_id AND a.parent_hash = b.parent_hash AND a.file_id <> b.file_id WHERE a.file_id % 5 <> 0 AND b.file_id % 7 <> 0", PARENTS)
def dependents(spark, d):
    p = t.parents(spark, d)
    return dedup.dependents(p.where("file_id % 5 != 0"), p.withColumn("deduplicated", F.col("file_id") % 7 != 0))


@query("SELECT tenant_id, kb_id, sha256, (min({'a': created_at, 'b': id})).b AS first_id, count(*) AS n_files FROM files GROUP BY tenant_id, kb_id, sha256 HAVING count(*) > 1", FILES)
def duplicate_files(spark, d):
    r = dedup.first_owner(t.files(spark, d))
    return r.select("tenant_id", "kb_id", "sha256", "first_id", "n_files")


@query("SELECT id, name, status, created_at FROM files WHERE status = 'done' AND tenant_id = 'en' AND contains(lower(name), 'doc-1') ORDER BY created_at DESC, id LIMIT 20 OFFSET 20", FILES)
def list_page(spark, d):
    """The second page of a filtered listing; the limit is the page."""
    return listing.newest(listing.files(t.files(spark, d), "DOC-1", status="done", tenant_id="en"), 2, 20).select("id", "name", "status", "created_at")


@query("SELECT id FROM files WHERE contains(lower(name), '1.md') AND kb_id IN ('src1', 'src2', 'src3')", FILES)
def file_ids_by_name(spark, d):
    return listing.files(t.files(spark, d), "1.MD", kb_id=["src1", "src2", "src3"]).select("id")


@query("SELECT tenant_id, status, count(*) AS n FROM files GROUP BY tenant_id, status", FILES)
def count_by_status(spark, d):
    return listing.count_by(t.files(spark, d), "tenant_id", "status")


@query("SELECT file_id, count(*) AS n FROM chunks GROUP BY file_id", CHUNKS)
def chunk_counts(spark, d):
    return listing.count_by(t.chunks(spark, d), "file_id")


@query("SELECT DISTINCT f.kb_id, c.child_hash FROM chunks c JOIN files f ON c.file_id = f.id WHERE f.status = 'done'", CHUNKS, FILES)
def inserted_hashes(spark, d):
    done = t.files(spark, d).where("status = 'done'").select("id", "kb_id")
    c = t.chunks(spark, d).select("file_id", "child_hash")
    return c.join(done, c["file_id"] == done["id"]).select("kb_id", "child_hash").distinct()


@query("+page AS (SELECT * FROM files ORDER BY created_at DESC, id LIMIT 50) SELECT p.id, p.name, (SELECT count(*) FROM chunks c WHERE c.file_id = p.id) AS n_chunks, CASE WHEN p.id % 4 = 0 THEN 'edited' WHEN p.id % 4 = 1 THEN 'cleaned' ELSE 'raw' END AS clean_state FROM page p", FILES, CHUNKS)
def list_files_composite(spark, d):
    f = t.files(spark, d)
    states = f.select(F.col("id").alias("file_id"), (F.col("id") % 4 == 0).alias("edited"), (F.col("id") % 4 == 1).alias("cleaned"))
    return listing.with_counts(listing.newest(f, 1, 50), t.chunks(spark, d), states).select("id", "name", "n_chunks", "clean_state")


@query("SELECT c.parent_id, count(*) AS n_children, coalesce(CASE WHEN c.file_id % 3 = 0 THEN 'live ' || c.parent_id WHEN c.file_id % 3 = 1 THEN 'staged ' || c.parent_id END, string_agg(c.content, chr(10) || chr(10) ORDER BY c.chunk_index)) AS content FROM chunks c WHERE c.parent_id IS NOT NULL GROUP BY c.file_id, c.parent_id", CHUNKS)
def chunk_tree_listing(spark, d):
    c = t.chunks(spark, d).where("parent_id is not null")
    p = c.select("file_id", "parent_id").distinct()
    live = p.where("file_id % 3 = 0").select("parent_id", F.concat(F.lit("live "), "parent_id").alias("content"))
    staged = p.where("file_id % 3 <= 1").select("parent_id", F.concat(F.lit("staged "), "parent_id").alias("content"))
    return listing.chunk_tree(c, live, staged).select("parent_id", F.col("n_children"), "content")


@query("SELECT file_id, chunk_index, content FROM chunks WHERE chunk_index % 3 <> 0 UNION ALL SELECT file_id, min(chunk_index), string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) FROM chunks WHERE chunk_index % 3 = 0 GROUP BY file_id", CHUNKS)
def merge_chunks(spark, d):
    return listing.merge_chunks(t.chunks(spark, d), ["file_id"], F.col("chunk_index") % 3 == 0)


@query("SELECT file_id, parent_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content, count(*) AS n_chunks FROM chunks WHERE parent_id IS NOT NULL GROUP BY file_id, parent_id", CHUNKS)
def rebuilt_parents(spark, d):
    return publishing.rebuilt_parents(t.chunks(spark, d).where("parent_id is not null"))


@query("SELECT coalesce(u.tenant_id, s.tenant_id) AS tenant_id, coalesce(u.kb_id, s.kb_id) AS kb_id, coalesce(u.parent_id, s.parent_id) AS parent_id, CASE WHEN u.parent_id IS NOT NULL THEN u.content ELSE s.content END AS content, CASE WHEN u.parent_id IS NOT NULL THEN u.status ELSE s.status END AS status, CASE WHEN s.parent_id IS NULL THEN 1 WHEN u.parent_id IS NOT NULL AND u.content_sha256 IS DISTINCT FROM s.content_sha256 THEN s.doc_version + 1 ELSE s.doc_version END AS doc_version FROM store s FULL JOIN updates u ON s.tenant_id = u.tenant_id AND s.kb_id = u.kb_id AND s.parent_id = u.parent_id", STORE, UPDATES)
def parent_upsert(spark, d):
    r = snapshots.upsert(t.parent_store(spark, d), t.parent_updates(spark, d), ["tenant_id", "kb_id", "parent_id"], "content_sha256")
    return r.select("tenant_id", "kb_id", "parent_id", "content", "status", "doc_version")


@query("SELECT u.parent_id, CASE WHEN s.parent_id IS NULL THEN 1 WHEN s.content_sha256 = u.content_sha256 THEN s.doc_version ELSE s.doc_version + 1 END AS target_version FROM updates u LEFT JOIN store s ON u.parent_id = s.parent_id", STORE, UPDATES)
def next_version(spark, d):
    return snapshots.next_versions(t.parent_store(spark, d), t.parent_updates(spark, d))


@query("SELECT parent_id, CASE WHEN tenant_id = 'Brand#11' AND parent_id % 4 <> 0 THEN 'deleted' ELSE status END AS status FROM store", STORE)
def parents_excluding(spark, d):
    p = t.parent_store(spark, d)
    return snapshots.soft_delete(p, F.col("tenant_id") == "Brand#11", p.where("parent_id % 4 = 0"), ["parent_id"]).select("parent_id", "status")


@query("SELECT DISTINCT tenant_id, kb_id FROM store WHERE status = 'active'", STORE)
def active_scopes(spark, d):
    return t.parent_store(spark, d).where("status = 'active'").select("tenant_id", "kb_id").distinct()


@query("SELECT s.parent_id, coalesce(CASE WHEN parent_id % 3 = 0 THEN 'Brand#99' END, tenant_id) AS tenant_id, coalesce(CASE WHEN parent_id % 6 = 0 THEN 'moved' END, kb_id) AS kb_id FROM store s", STORE)
def meta_patch(spark, d):
    p = t.parent_store(spark, d)
    changes = p.where("parent_id % 3 = 0").select("parent_id", F.lit("Brand#99").alias("tenant_id"), F.when(F.col("parent_id") % 6 == 0, "moved").alias("kb_id"))
    return snapshots.patch(p, changes, ["parent_id"]).select("parent_id", "tenant_id", "kb_id")


@query("SELECT doc_id AS file_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 2 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'clean' END AS cleaned, CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 3 END AS version FROM documents UNION ALL SELECT doc_id + 1000000000, NULL, 1 FROM documents WHERE doc_id % 10 = 0")
def conversion_upsert(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("raw"))
    old = docs.select("file_id", "raw", F.when(F.col("file_id") % 7 == 0, "clean").alias("cleaned"), F.lit(3).cast("long").alias("version"))
    new = docs.where("file_id % 2 = 0").withColumn("raw", F.when(F.col("file_id") % 4 == 0, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")))
    more = docs.where("file_id % 10 = 0").withColumn("file_id", F.col("file_id") + 1000000000)
    return publishing.converted(old, new.unionByName(more)).select("file_id", "cleaned", "version")


RECON = (
    "+active AS (SELECT * FROM store WHERE status = 'active'), v AS (SELECT tenant_id, kb_id, parent_id, min(doc_version) AS doc_version FROM pvectors WHERE is_current GROUP BY tenant_id, kb_id, parent_id) "
    "SELECT 'missing' AS problem, a.tenant_id, a.kb_id, a.parent_id FROM active a ANTI JOIN v ON a.tenant_id = v.tenant_id AND a.kb_id = v.kb_id AND a.parent_id = v.parent_id WHERE NOT a.deduplicated "
    "UNION ALL SELECT 'stale', a.tenant_id, a.kb_id, a.parent_id FROM active a JOIN v ON a.tenant_id = v.tenant_id AND a.kb_id = v.kb_id AND a.parent_id = v.parent_id WHERE v.doc_version < a.doc_version "
    "UNION ALL SELECT 'orphan', v.tenant_id, v.kb_id, v.parent_id FROM v ANTI JOIN active a ON a.tenant_id = v.tenant_id AND a.kb_id = v.kb_id AND a.parent_id = v.parent_id "
    "UNION ALL SELECT DISTINCT 'stale_scope', p.tenant_id, p.kb_id, p.parent_id FROM pvectors p JOIN store s ON p.file_id = s.parent_id WHERE p.is_current AND (p.tenant_id <> s.tenant_id OR p.kb_id <> s.kb_id)"
)


@query(RECON, STORE, PVECTORS)
def reconcile(spark, d):
    files = t.parent_store(spark, d).select(F.col("parent_id").alias("file_id"), "tenant_id", "kb_id")
    return publishing.reconcile(t.parent_store(spark, d), t.parent_vectors(spark, d), files)


@query("SELECT v.vector_id FROM pvectors v JOIN store s ON v.file_id = s.parent_id AND v.tenant_id = s.tenant_id AND v.kb_id = s.kb_id WHERE v.vector_id NOT IN (SELECT parent_id || ':' || doc_version FROM store)", STORE, PVECTORS)
def superseded_vectors(spark, d):
    p = t.parent_store(spark, d)
    scopes = p.select(F.col("parent_id").alias("file_id"), "tenant_id", "kb_id")
    keep = p.select(F.concat_ws(":", F.col("parent_id").cast("string"), F.col("doc_version").cast("string")).alias("vector_id"))
    return publishing.superseded(t.parent_vectors(spark, d), scopes, keep).select("vector_id")


@query("SELECT file_id, tenant_id, kb_id FROM pvectors UNION SELECT parent_id, tenant_id, kb_id FROM store", STORE, PVECTORS)
def published_scopes(spark, d):
    p = t.parent_store(spark, d).select(F.col("parent_id").alias("file_id"), "tenant_id", "kb_id")
    return publishing.published_scopes(p, p.where("file_id % 2 = 0"), t.parent_vectors(spark, d))


@query("SELECT user_id AS file_id, max({'a': ts, 'b': event_id}).b AS job_id, max({'a': ts, 'b': event_id, 'c': event_type}).c AS state FROM events GROUP BY user_id")
def latest_jobs(spark, d):
    return publishing.latest_jobs(t.jobs(spark, d)).select("file_id", "job_id", "state")


@query("SELECT event_id AS job_id FROM events WHERE event_type IN ('click', 'view') AND ts < (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def stale_jobs(spark, d):
    j = t.jobs(spark, d)
    now = F.lit(j.agg(F.max("updated_at")).first()[0])
    return publishing.stale(j, now, 3600, ["click", "view"]).select("job_id")


@query("SELECT event_id AS job_id, CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 1800 SECOND THEN CASE event_type WHEN 'click' THEN 'uploaded' WHEN 'view' THEN 'converted' ELSE event_type END ELSE event_type END AS state FROM events")
def recovered_jobs(spark, d):
    j = t.jobs(spark, d)
    now = F.lit(j.agg(F.max("updated_at")).first()[0])
    return publishing.recovered(j, {"click": "uploaded", "view": "converted"}, now, 1800).select("job_id", "state")


COS = "list_dot_product(CAST(embedding AS DOUBLE[]), q.v) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(q.v, q.v))"
Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


def _query_vector(spark, d):
    return [float(x) for x in t.table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


@query(f"SELECT vec_id, space_id, round(score, 6) AS score FROM (SELECT vec_id, CAST(label AS BIGINT) AS space_id, {COS} AS score FROM embeddings, q WHERE vec_id % 5 <> 0 AND label IN (1, 2, 3)) ORDER BY score DESC, vec_id LIMIT 20", Q)
def topk_cosine(spark, d):
    """Exact top-k under a filter that comes before ranking."""
    return vectors.top_k(t.vectors(spark, d), _query_vector(spark, d), 20, where=F.col("space_id").isin(1, 2, 3)).select("vec_id", "space_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, CAST(label AS BIGINT) AS space_id FROM embeddings WHERE label = 4 ORDER BY vec_id LIMIT 10 OFFSET 10")
def vector_documents(spark, d):
    return vectors.documents(t.vectors(spark, d), 2, 10, "vec_id", space_id=4, tenant_id="absent").select("vec_id", "space_id")


@query("SELECT vec_id, CAST(label AS BIGINT) + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS space_id FROM embeddings")
def vector_upsert(spark, d):
    v = t.vectors(spark, d).select("vec_id", "space_id")
    return snapshots.replace_by_key(v, v.where("vec_id % 3 = 0").withColumn("space_id", F.col("space_id") + 100), ["vec_id"])


@query("SELECT vec_id FROM embeddings WHERE NOT (vec_id % 10 = 0) AND NOT (vec_id % 4 = 1 AND label = 3)")
def vector_purge(spark, d):
    v = t.vectors(spark, d).select("vec_id", F.when(F.col("vec_id") % 4 == 1, "").otherwise(F.col("vec_id").cast("string")).alias("file_id"), F.concat(F.lit("name-"), F.col("space_id").cast("string")).alias("source_name"))
    gone = t.table(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("file_id"), F.lit("shared").alias("name"), F.lit(2).alias("n_same_name"))
    named = spark.createDataFrame([("gone", "name-3", 1)], "file_id string, name string, n_same_name int")
    return vectors.purge(v, gone.unionByName(named)).select("vec_id")


BM = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'ention')) AS b, len(list_filter(w, lambda x: x = 'que')) AS e FROM w), s AS (SELECT count(*) AS nd, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (e > 0) AS de FROM c)"


@query("SELECT doc_id, round(ln(1 + (nd - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (nd - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (nd - de + 0.5) / (de + 0.5)) * e * 2.2 / (e + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE a + b + e > 0 ORDER BY score DESC, doc_id LIMIT 20", BM)
def bm25_topk(spark, d):
    return vectors.bm25(spread(t.table(spark, d, "documents").select("doc_id", "text")), ["the", "ention", "que"], 20).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT p.page_id, p.current_revision_id AS revision_id FROM pages p JOIN revisions r ON p.page_id = r.page_id AND p.current_revision_id = r.revision_id WHERE p.status = 'published' AND p.deleted_at IS NULL", PAGES, REVISIONS)
def published_pairs(spark, d):
    return wiki.published_pairs(t.pages(spark, d), t.revisions(spark, d))


@query("SELECT page_id, arg_max(content_md, revision_id) AS content_md, max(revision_id) AS revision_id FROM revisions GROUP BY page_id", REVISIONS)
def latest_per_key(spark, d):
    return wiki.latest(t.revisions(spark, d))


@query("SELECT p.page_id, coalesce(max(r.revision_id), 0) + 1 AS next_revision FROM pages p LEFT JOIN revisions r ON p.page_id = r.page_id GROUP BY p.page_id", PAGES, REVISIONS)
def next_revision(spark, d):
    return wiki.next_revision(t.pages(spark, d), t.revisions(spark, d))


@query("RECURSIVE +r AS (SELECT id, id AS root, 0 AS depth, mark AS marked FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, r.root, r.depth + 1, r.marked OR t.mark FROM tree t JOIN r ON t.parent_id = r.id) SELECT id, root, depth, marked FROM r", TREE)
def page_tree(spark, d):
    """Root, depth and inherited trash mark of every node."""
    return wiki.climb(t.tree(spark, d))


@query("SELECT page_id, target, to_page FROM links", PAGES, REVISIONS, LINKS)
def page_links(spark, d):
    return wiki.link_rows(t.revisions(spark, d), t.pages(spark, d))


@query("SELECT DISTINCT to_page AS page_id, l.page_id AS from_page FROM links l JOIN pages p ON l.page_id = p.page_id WHERE to_page IS NOT NULL AND p.deleted_at IS NULL", PAGES, REVISIONS, LINKS)
def backlinks(spark, d):
    p = t.pages(spark, d)
    return wiki.backlinks(wiki.link_rows(t.revisions(spark, d), p), p)


@query("SELECT s_suppkey AS user_id, s_suppkey % 8 AS space_id FROM supplier WHERE s_suppkey % 3 IN (0, 1)")
def writable_spaces(spark, d):
    m, s = t.members(spark, d), t.spaces(spark, d)
    return s.join(m, "space_id").where(wiki.may(F.col("role"), F.col("visibility"), "write")).select("user_id", "space_id")


@query("SELECT CAST(n_nationkey AS BIGINT) AS space_id FROM nation WHERE n_nationkey < 8 AND (n_nationkey % 4 = 0 OR n_nationkey IN (SELECT s_suppkey % 8 FROM supplier WHERE s_suppkey = 5))")
def accessible_spaces(spark, d):
    return wiki.accessible(t.spaces(spark, d), t.members(spark, d), 5)


@query("SELECT m.s_suppkey AS user_id, m.s_suppkey % 8 AS space_id, s.s_name AS name, coalesce(c.c_name, 'system') AS author FROM supplier m JOIN supplier s ON m.s_suppkey = s.s_suppkey LEFT JOIN customer c ON c.c_custkey = m.s_suppkey * 40")
def member_names(spark, d):
    """Members with their names, and a left join whose missing side has a default."""
    m, u = t.members(spark, d), t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("_k"), F.col("c_name").alias("_n"))
    return m.join(u, "user_id").join(c, F.col("user_id") * 40 == F.col("_k"), "left").select("user_id", "space_id", "name", F.coalesce("_n", F.lit("system")).alias("author"))


@query("SELECT page_id FROM pages WHERE deleted_at IS NOT NULL AND deleted_at < 40", PAGES)
def expired_trash(spark, d):
    return t.pages(spark, d).where("deleted_at is not null and deleted_at < 40").select("page_id")


@query("SELECT page_id AS id FROM pages UNION ALL SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)", PAGES)
def import_once(spark, d):
    ids = t.pages(spark, d).select(F.col("page_id").alias("id"))
    return snapshots.insert_missing(ids, t.table(spark, d, "documents").select(F.col("doc_id").alias("id")), ["id"])


@query(f"SELECT vec_id, v.page_id, round(score, 6) AS score, p.title FROM (SELECT vec_id, vec_id % 60 AS page_id, {COS} AS score FROM embeddings, q WHERE vec_id % 5 <> 0 AND label IN (0, 4, 5)) v JOIN pages p ON v.page_id = p.page_id WHERE p.status = 'published' AND p.deleted_at IS NULL AND EXISTS (SELECT 1 FROM revisions r WHERE r.page_id = p.page_id AND r.revision_id = p.current_revision_id) ORDER BY score DESC, vec_id LIMIT 15", Q, PAGES, REVISIONS)
def search_wiki(spark, d):
    """Semantic search among published pages of the spaces a user may read."""
    p = t.pages(spark, d)
    v = t.vectors(spark, d).withColumn("page_id", F.col("vec_id") % 60).join(p.select("page_id", F.col("current_revision_id").alias("revision_id")), "page_id")
    found = wiki.search(v, _query_vector(spark, d), 15, p, t.revisions(spark, d), wiki.accessible(t.spaces(spark, d), t.members(spark, d), 5))
    return found.select("vec_id", "page_id", F.round("score", 6).alias("score"), "title")


def _micros(c: str):
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_fixed(spark, d):
    r = limits.aligned_rates(t.table(spark, d, "events"), "user_id", 1, "1 hour")
    return r.select(_micros("start").alias("start"), "user_id", "n")


LOCK = "e AS (SELECT *, event_type = 'click' AS f, lag(event_type = 'click') OVER w AS pf, lag(ts) OVER w AS pt FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(CASE WHEN pt IS NULL OR NOT pf OR epoch_us(ts) - epoch_us(pt) >= 864000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), n AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_failures FROM g)"


@query("SELECT user_id, event_id, CAST(n_failures AS BIGINT) AS n_failures FROM n WHERE f AND n_failures >= 3", LOCK)
def lockouts(spark, d):
    e = t.table(spark, d, "events")
    return limits.lockouts(e, "user_id", F.col("event_type") == "click", F.col("event_type") == "purchase", 3, 864000).select("user_id", "event_id", "n_failures")


@query("SELECT user_id, event_type, min(epoch_us(ts)) AS first_us FROM events GROUP BY user_id, event_type")
def first_requests(spark, d):
    """The first request of each idempotency key, as a table; streams use ``first_of_each``."""
    return t.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(_micros("ts")).alias("first_us"))


@query(r"SELECT page_id, regexp_replace(url || '/' || md5(url) || '/x', '/[0-9a-f]{32}', '/{id}', 'g') AS path FROM pages")
def metric_paths(spark, d):
    p = t.table(spark, d, "pages")
    return p.select("page_id", text.metric_path(F.concat("url", F.lit("/"), F.md5("url"), F.lit("/x"))).alias("path"))


@query(r"SELECT page_id, CASE WHEN regexp_extract(lower(url), '\.[a-z0-9]+$') IN ('.pdf', '.docx', '.pptx', '.html', '.md', '.txt') THEN 'text' WHEN regexp_extract(lower(url), '\.[a-z0-9]+$') IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp') THEN 'image' END AS type FROM pages")
def file_types(spark, d):
    return t.table(spark, d, "pages").select("page_id", text.file_type(F.col("url")).alias("type"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words FROM documents")
def word_counts(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("n_words"))


@query()
def html_to_markdown(spark, d):
    m = spread(t.table(spark, d, "pages").select("page_id", "html")).select("page_id", html.markdown_of(F.col("html"), True).alias("markdown"))
    return m.withColumn("table_count", html.table_lines(F.col("markdown")))


@query()
def clean_markdown(spark, d):
    return markdown.clean(spread(t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), "text").drop("text")


@query()
def clean_report(spark, d):
    """How many edits of each kind the cleaner makes, and in how many documents."""
    done = spread(t.table(spark, d, "documents").select("text")).select(markdown.cleaned(F.col("text")).alias("c"))
    each = done.select(F.explode("c.counts").alias("kind", "n"))
    return each.groupBy("kind").agg(F.sum("n").alias("n_edits"), F.sum((F.col("n") > 0).cast("long")).alias("n_documents"))


@query()
def chunk_tree(spark, d):
    return chunking.chunk_tree(spread(t.table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "parent_id", "title", "chunk_index", "content", "tokens")


@query()
def exact_fingerprints(spark, d):
    """Hashes under NFKC and full case folding, which SQL can't express."""
    return t.table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query()
def revision_diffs(spark, d):
    """Line differences between neighbouring revisions."""
    from pyspark.sql import Window

    r = t.revisions(spark, d)
    before = F.lag("content_md").over(Window.partitionBy("page_id").orderBy("revision_id"))
    return r.select("page_id", "revision_id", "content_md", before.alias("_before")).select("page_id", "revision_id", F.to_json(wiki.line_diff(F.col("_before"), F.col("content_md"))).alias("diff"))


@query(
    r"+l AS (SELECT file_id AS doc, i AS line, trim(content) AS title, regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g') AS key, i // 6 AS page, greatest(len(content), 1) * 10.0 AS area FROM lines WHERE trim(content) <> ''),"
    r" k AS (SELECT *, regexp_matches(title, '^(?i:(part\s*)?\d{1,3}|thanks|business|contents)$') AS noise, regexp_matches(title, '^(?i:part\s*)?\d{1,3}\s') AS numbered FROM l),"
    " c AS (SELECT doc, key, min(line) AS ord, arg_max(page, line) AS page, arg_max(area, line) AS area FROM k WHERE NOT noise AND len(title) <= 200 AND key <> '' GROUP BY doc, key),"
    " near AS (SELECT h.doc, h.line, arg_min({'key': c.key, 'page': c.page, 'area': c.area}, c.ord) AS c FROM (SELECT k.* FROM k ANTI JOIN c USING (doc, key)) h JOIN c ON h.doc = c.doc AND len(h.key) >= 2 AND (contains(c.key, h.key) OR contains(h.key, c.key)) GROUP BY ALL),"
    " hit AS (SELECT k.*, coalesce(c.page, n.c.page) AS p, coalesce(c.area, n.c.area) AS a FROM k LEFT JOIN c USING (doc, key) LEFT JOIN near n ON n.doc = k.doc AND n.line = k.line),"
    " m AS (SELECT *, p IS NOT NULL AND NOT noise AND len(title) <= 120 AS counts FROM hit), d AS (SELECT doc, bool_or(counts) AS found, min(line) AS start, min(p) FILTER (counts) AS first, max(p) FILTER (counts) AS last FROM m GROUP BY doc),"
    " num AS (SELECT DISTINCT doc, page FROM k WHERE numbered OR (noise AND len(title) <= 4)),"
    " r AS (SELECT doc, line, p, row_number() OVER w AS rank, count(*) OVER (PARTITION BY doc, p) AS n, a, min(line) OVER (PARTITION BY doc, p) AS top FROM m WHERE counts WINDOW w AS (PARTITION BY doc, p ORDER BY a DESC, line)),"
    " x AS (SELECT doc, p, max(a) FILTER (rank = 1) / max(a) FILTER (rank = 2) AS ratio, min(top) AS top FROM r GROUP BY doc, p),"
    " y AS (SELECT doc, p, ratio, top, EXISTS (SELECT 1 FROM num z WHERE z.doc = x.doc AND z.page = x.p) AS numbered FROM x),"
    " v AS (SELECT *, coalesce(max(numbered::INT) OVER (PARTITION BY doc ORDER BY top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS chapter FROM y),"
    " e AS (SELECT r.doc, r.line, CASE WHEN r.p = d.first THEN CASE WHEN r.line = d.start THEN 1 ELSE 2 END WHEN r.n = 1 AND r.p <> d.last AND v.chapter AND NOT v.numbered THEN 3 WHEN v.ratio IS NULL OR v.ratio >= 1.25 THEN CASE WHEN r.rank = 1 THEN 2 ELSE 3 END WHEN r.n >= 4 THEN 3 ELSE 2 END AS level FROM r JOIN d USING (doc) JOIN v ON v.doc = r.doc AND v.p = r.p)"
    " SELECT m.doc, m.line, CASE WHEN m.noise AND (d.found OR m.p IS NOT NULL) THEN 0 ELSE coalesce(e.level, CASE WHEN d.found AND m.line = d.start THEN 1 END, 2) END::INTEGER AS level FROM m JOIN d USING (doc) LEFT JOIN e ON e.doc = m.doc AND e.line = m.line",
    CHUNKS,
)
def heading_levels(spark, d):
    """Levels of all lines as if they were headings of the second level: their order as pages, their length as boxes."""
    c = t.chunks(spark, d).where("trim(content) <> ''").select(F.col("file_id").alias("doc"), F.col("chunk_index").alias("line"), F.trim("content").alias("title"), F.length("content").alias("n"))
    h = c.select("doc", "line", F.lit(2).alias("level"), "title")
    page = F.floor(F.col("line") / 6).cast("int")
    items = c.select("doc", F.col("line").alias("ord"), page.alias("page"), "title", F.lit(True).alias("is_title"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("n").cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    return headings.levels(h, items)


@query(
    "SELECT file_id, content, row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1 AS chunk_index"
    " FROM (SELECT *, row_number() OVER (PARTITION BY file_id, child_hash ORDER BY seq) AS turn FROM chunks) WHERE turn = 1",
    CHUNKS,
)
def page_wide_children(spark, d):
    """Children that repeat anywhere in a page go, the others are numbered anew without gaps."""
    return dedup.renumbered(dedup.keep_first(t.chunks(spark, d), ["file_id", "child_hash"], "seq"), ["file_id"], "seq", "chunk_index").select("file_id", "content", "chunk_index")


@query("SELECT id, name, (SELECT count(*) FROM files WHERE status = 'done') AS total FROM files WHERE status = 'done' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20", FILES)
def files_page_with_total(spark, d):
    """The second page of the finished files beside their number."""
    return listing.page_with_total(listing.files(t.files(spark, d), status="done"), [F.desc("created_at"), F.asc("id")], 2).select("id", "name", "total")


@query(
    "SELECT kb_id, count(*) AS n_files, sum(n)::BIGINT AS n_chunks FROM (SELECT f.id, f.kb_id, count(c.file_id) AS n FROM files f LEFT JOIN chunks c ON c.file_id = f.id WHERE f.status <> 'failed' GROUP BY f.id, f.kb_id) GROUP BY kb_id",
    FILES,
    CHUNKS,
)
def after_cascade(spark, d):
    """Files and chunks of each base after failed files are deleted with their chunks."""
    files, chunks = t.files(spark, d), t.chunks(spark, d)
    left, children = listing.delete_cascade(files, F.col("status") == "failed", "id", chunks, "file_id")
    n = children.groupBy("file_id").agg(F.count("*").alias("n"))
    return left.join(n, left["id"] == n["file_id"], "left").groupBy("kb_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


@query("SELECT label AS space_id, count(*) AS n_vectors, sum(CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_current, min(len(embedding)) AS least_size, max(len(embedding)) AS most_size FROM embeddings GROUP BY label")
def vector_stats(spark, d):
    """Vectors of each space, how many are current, and their numbers of components."""
    return vectors.stats(t.vectors(spark, d), "space_id").withColumn("least_size", F.col("least_size").cast("long")).withColumn("most_size", F.col("most_size").cast("long"))


@query("SELECT count(*) AS n_vectors, min(vec_id) AS least, max(vec_id) AS most FROM embeddings WHERE label <> 3 AND vec_id < 400 AND vec_id % 5 <> 0")
def vectors_below(spark, d):
    """Current vectors under an inequality and a bound."""
    v = t.vectors(spark, d)
    return v.where(all_of(differs(v, space_id=3), below(v, vec_id=400), equals(v, is_current=True))).agg(F.count("*").alias("n_vectors"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most"))


@query("SELECT tenant_id, count(*) AS n_left FROM files WHERE NOT (name LIKE 'doc-1%' AND status <> 'done') GROUP BY tenant_id", FILES)
def deleted_by_name(spark, d):
    """Files of each tenant left after those with a name's beginning that aren't finished are deleted."""
    f = t.files(spark, d)
    return f.where(~all_of(starts_with("name", "doc-1"), differs(f, status="done"))).groupBy("tenant_id").agg(F.count("*").alias("n_left"))


@query(
    "SELECT parent_id, status, CASE WHEN status <> 'deleted' AND kb_id LIKE '%STEEL' THEN 'deleted' ELSE status END AS after_scopes,"
    " CASE WHEN status <> 'deleted' AND tenant_id <> 'Brand#11' THEN 'deleted' ELSE status END AS after_outside FROM store",
    STORE,
)
def scoped_deletes(spark, d):
    """Parents after soft deletes within scopes (steel bases, none of them the current scope) and outside one."""
    p = t.parent_store(spark, d)
    keys = ["tenant_id", "kb_id", "parent_id"]
    scopes = p.where("kb_id like '%STEEL'").select("tenant_id", "kb_id").distinct()
    within = publishing.delete_in_scopes(p, scopes, "none", "none", p.where("parent_id % 4 = 0")).select(*keys, F.col("status").alias("after_scopes"))
    outside = snapshots.soft_delete(p, F.col("tenant_id") != "Brand#11").select(*keys, F.col("status").alias("after_outside"))
    return p.join(within, keys).join(outside, keys).select("parent_id", "status", "after_scopes", "after_outside")


@query(
    "SELECT parent_id, CASE WHEN status <> 'deleted' AND (tenant_id = 'Brand#12' OR tenant_id = 'Brand#11' AND NOT (kb_id = 'PROMO BURNISHED COPPER' AND parent_id % 4 = 0)) THEN 'deleted' ELSE status END AS status FROM store",
    STORE,
)
def deletes_keeping_current(spark, d):
    """Soft deletes in every scope of two tenants; only the current scope keeps the parents just published."""
    p = t.parent_store(spark, d)
    scopes = p.where("tenant_id in ('Brand#11', 'Brand#12')").select("tenant_id", "kb_id").distinct()
    return publishing.delete_in_scopes(p, scopes, "Brand#11", "PROMO BURNISHED COPPER", p.where("parent_id % 4 = 0")).select("parent_id", "status")


@query(
    "SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'old' ELSE 'same' END AS markdown, CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'old' END AS raw,"
    " CASE doc_id % 3 WHEN 2 THEN 'edited' WHEN 1 THEN 'raw' ELSE 'cleaned' END AS clean_state, CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 5 END AS version FROM documents WHERE doc_id % 3 <> 2"
    " UNION ALL SELECT doc_id, 'edit', CASE WHEN doc_id % 2 = 0 THEN 'edit' WHEN doc_id % 4 = 1 THEN 'raw' END, CASE WHEN doc_id % 2 = 0 THEN 'edited' ELSE 'cleaned' END, 6 FROM documents WHERE doc_id % 3 = 2",
)
def conversion_edits(spark, d):
    """Conversions after a cleaning of some (the raw text is kept, the version rises only with the text) and edits of others."""
    k = F.col("file_id")
    ids = t.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"))
    old = ids.select("file_id", F.lit("old").alias("markdown"), F.when(k % 3 == 2, F.when(k % 4 == 1, "raw")).otherwise(F.when(k % 2 == 0, "raw")).alias("raw"), F.lit("raw").alias("clean_state"), F.lit(5).cast("long").alias("version"))
    cleaned = ids.where("file_id % 3 <> 2").select("file_id", F.when(k % 3 == 0, "new").otherwise("old").alias("markdown"), F.lit("old").alias("source"))
    edits = ids.where("file_id % 3 = 2").select("file_id", F.lit("edit").alias("markdown"), F.when(k % 2 == 0, "raw").otherwise("cleaned").alias("target"))
    done = publishing.mark_cleaned(old, cleaned).withColumn("clean_state", F.when(k % 3 == 1, "raw").otherwise(F.col("clean_state")))
    return publishing.edit_conversions(done, edits)


@query(
    "SELECT page_id, max(revision_id) AS latest, CASE WHEN max(revision_id) IS NOT NULL AND bool_or(v.revision IS NOT NULL) THEN 'published' ELSE 'draft' END AS status FROM (SELECT p.page_id, r.latest AS revision_id FROM pages p LEFT JOIN (SELECT page_id, max(revision_id) AS latest FROM revisions GROUP BY page_id) r ON p.page_id = r.page_id WHERE p.page_id % 2 = 0) x"
    " LEFT JOIN (SELECT vec_id % 60 AS page, vec_id % 5 AS revision FROM embeddings) v ON v.page = x.page_id AND v.revision = x.revision_id GROUP BY page_id",
    PAGES,
    REVISIONS,
)
def recovered_publishes(spark, d):
    """Pages stuck in publishing: published where the newest revision has vectors, else drafts again."""
    k = F.col("vec_id")
    v = t.vectors(spark, d).select((k % 60).alias("page_id"), (k % 5).alias("revision_id"))
    return wiki.recovered(t.pages(spark, d).where("page_id % 2 = 0"), t.revisions(spark, d), v).select("page_id", "latest", "status")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 60 NOT IN (SELECT page_id FROM pages) OR vec_id % 5 = 1", PAGES)
def converged_vectors(spark, d):
    """Vectors left when every page keeps those of one revision; vectors of unknown pages stay."""
    k = F.col("vec_id")
    v = t.vectors(spark, d).select("vec_id", (k % 60).alias("page_id"), (k % 5).alias("revision_id"))
    return wiki.keep_revision(v, t.pages(spark, d).select("page_id", F.lit(1).cast("long").alias("revision_id"))).select("vec_id")


@query(
    "RECURSIVE +s AS (SELECT id, id % 10 = 0 AS gone FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, s.gone OR t.id % 10 = 0 FROM tree t JOIN s ON t.parent_id = s.id)"
    " SELECT id FROM s WHERE NOT gone",
    TREE,
)
def purged_tree(spark, d):
    """Nodes left after every tenth is purged with all that lies below it."""
    return wiki.purged(t.tree(spark, d), F.col("id") % 10 == 0).select("id")


@query(
    "SELECT event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE event_type END AS state, CASE WHEN event_id % 6 = 0 THEN 7 ELSE event_id % 100 END AS indexed_chunks,"
    " CASE WHEN event_id % 9 = 0 THEN 2000 ELSE 3 END AS error_chars, CASE WHEN event_id % 6 = 3 THEN 2 ELSE 1 END AS retry_count FROM events"
)
def updated_jobs(spark, d):
    """Jobs after every third one failed: some with a count, an error that is too long, or another try."""
    k = F.col("job_id")
    jobs = t.jobs(spark, d).select("job_id", "state", (k % 100).alias("indexed_chunks"), F.lit("old").alias("last_error"), F.lit(1).cast("long").alias("retry_count"))
    updates = jobs.where("job_id % 3 = 0").select(
        "job_id", F.lit("failed").alias("state"), F.when(k % 6 == 0, 7).cast("long").alias("indexed_chunks"), F.when(k % 9 == 0, F.repeat(F.lit("x"), 3000)).alias("error"), (k % 6 == 3).alias("retry")
    )
    return publishing.update_jobs(jobs, updates).select("job_id", "state", "indexed_chunks", F.length("last_error").cast("long").alias("error_chars"), "retry_count")


@query("SELECT seq, CASE WHEN seq % 5 = 1 THEN 'edited ' || content ELSE content END AS content FROM chunks WHERE seq % 7 <> 0", CHUNKS)
def edited_chunks(spark, d):
    """Chunks after some were deleted and others rewritten."""
    c = t.chunks(spark, d)
    edits = c.where("seq % 5 = 1").select("seq", F.concat(F.lit("edited "), "content").alias("content"))
    return listing.edit_chunks(c, edits, c.where("seq % 7 = 0")).select("seq", "content")


@query("SELECT page_id, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY revision_id DESC) AS turn FROM revisions) WHERE turn <= 2", REVISIONS)
def newest_revisions(spark, d):
    """The two newest revisions of each page."""
    return wiki.newest_revisions(t.revisions(spark, d), 2).select("page_id", "revision_id")


# A rule that SQL can state too; ``markdown.clean`` and ``chunking.chunk_tree`` take the same place.
def _squeezed(texts: DataFrame) -> DataFrame:
    return texts.select("sha", F.regexp_replace("text", "[ \\t]+", " ").alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("sha", F.posexplode(F.split("text", "\n", -1)).alias("line", "content")).where("content <> ''")


@query(
    "WITH arrived AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 100 AS k FROM documents), second AS (SELECT doc_id, k, text,"
    " CASE WHEN k = 0 THEN text || '  changed' WHEN k IN (1, 2) THEN 'edited  ' || doc_id END AS came FROM arrived),"
    " squeezed AS (SELECT *, regexp_replace(text, '[ \t]+', ' ', 'g') AS one, regexp_replace(came, '[ \t]+', ' ', 'g') AS two FROM second),"
    " served AS (SELECT doc_id AS file_id, CASE WHEN k = 1 THEN 'edited' ELSE 'cleaned' END AS clean_state, CASE k WHEN 0 THEN two WHEN 1 THEN came WHEN 2 THEN came ELSE one END AS text,"
    " 1 + (one <> text)::BIGINT + CASE WHEN k = 0 THEN 1 + (two <> came)::BIGINT WHEN k IN (1, 2) THEN 1 ELSE 0 END AS version FROM squeezed)"
    " SELECT file_id, clean_state, version, sha256(text) AS sha, len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))::BIGINT AS n_chunks FROM served"
)
def maintained_corpus(spark, d):
    """Texts kept cleaned and cut through two arrivals: all documents; then new texts for some, edits by hand of raw and cleaned
    texts, some unchanged texts, and cleanings forced anew."""
    c = maintained.Corpus(spark, scratch(spark, "corpus"), _squeezed, _lines, "squeezed-1", "lines-1")
    docs, k = t.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text"), F.col("file_id") % 100
    c.arrive(docs.withColumn("kind", F.lit("converted")))
    c.refresh()
    kind = F.when(k == 1, "raw_edit").when(k == 2, "cleaned_edit").otherwise("converted")
    came = F.when(k == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("  changed"))).when(k == 3, F.col("text")).otherwise(F.concat(F.lit("edited  "), "file_id"))
    c.arrive(docs.where(k <= 3).select("file_id", kind.alias("kind"), came.alias("text")))
    c.refresh(force=docs.where(k == 4))
    served = c.served(lambda x: F.sha2(x, 256)).withColumnRenamed("text", "sha")
    return served.join(c.chunk_counts(), "file_id", "left").select("file_id", "clean_state", "version", "sha", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query(
    "WITH p AS (SELECT p_brand AS tenant_id, p_type AS kb_id, p_partkey AS id, p_partkey % 100 AS file_id FROM part), step AS (SELECT unnest(['embedding', 'vector_verified', 'switching', 'switched', 'cleanup_pending', 'done']) AS step, unnest([0, 0, 0, 1, 1, 2]) AS nth),"
    " mine AS (SELECT *, file_id % 10 = 3 AS again, file_id % 10 = 3 AND id % 3 <> 0 AS kept FROM p)"
    " SELECT step, 'parent' AS kind, id::VARCHAR AS key, CASE WHEN nth = 2 AND again AND NOT kept THEN 'deleted' ELSE 'active' END AS status, CASE WHEN nth > 0 AND kept AND id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM mine, step"
    " UNION ALL SELECT step, 'vector', id || ':' || c, NULL, 1 FROM mine, step, (SELECT unnest([0, 1]) AS c) WHERE nth < 2 OR NOT again"
    " UNION ALL SELECT step, 'vector', id || ':n', NULL, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END FROM mine, step WHERE nth > 0 AND kept"
)
def publish_steps(spark, d):
    """What readers see after each step of a publish that replaces the parents and vectors of some files."""
    base = publish_flow.Base(spark, scratch(spark, "base"))
    p = t.table(spark, d, "part").select(F.col("p_brand").alias("tenant_id"), F.col("p_type").alias("kb_id"), F.col("p_partkey").alias("_id"), F.col("p_partkey").cast("string").alias("parent_id"), (F.col("p_partkey") % 100).alias("file_id"), F.col("p_name").alias("content"))
    places = p.select("file_id", "tenant_id", "kb_id").distinct()

    def vectors_of(rows, names):
        return rows.withColumn("chunk_index", F.explode(F.array(*[F.lit(n) for n in names]))).select("*", F.concat_ws(":", "parent_id", "chunk_index").alias("vector_id"), F.array(F.col("_id").cast("float")).alias("embedding"))

    base.publish("first", p, vectors_of(p, ["0", "1"]), places)
    again = p.where("file_id % 10 = 3 and _id % 3 <> 0").withColumn("content", F.when(F.col("_id") % 2 == 0, F.concat("content", F.lit(" revised"))).otherwise(F.col("content")))
    at: dict[str, dict] = {}
    base.publish("second", again, vectors_of(again, ["n"]).withColumn("chunk_index", F.lit(0)), places.where("file_id % 10 = 3"), stop=lambda step: at.update({step: base.log.read()}))
    at["done"] = base.log.read()
    none = F.lit(None).cast("string")
    rows = [
        part
        for step, m in at.items()
        for part in (
            base.parents_at(m).select(F.lit(step).alias("step"), F.lit("parent").alias("kind"), F.col("parent_id").alias("key"), "status", F.col("doc_version").alias("version")),
            base.vectors_at(m).select(F.lit(step).alias("step"), F.lit("vector").alias("kind"), F.col("vector_id").alias("key"), none.alias("status"), F.col("doc_version").alias("version")),
        )
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"SELECT vec_id, space_id, round(score, 6) AS score FROM (SELECT vec_id, CAST(label AS BIGINT) AS space_id, {COS} AS score FROM embeddings, q WHERE vec_id % 5 <> 0 AND label IN (1, 2, 3)) ORDER BY score DESC, vec_id LIMIT 20", Q)
def ivf_topk(spark, d):
    """The same top-k by inverted lists, all of which are probed."""
    index = search_index.VectorLists.build(t.vectors(spark, d), scratch(spark, "lists"))
    found = index.top_k(_query_vector(spark, d), 20, search_index.LISTS, where=F.col("space_id").isin(1, 2, 3))
    return found.select("vec_id", "space_id", F.round("score", 6).alias("score"))


@query()
def ivf_recall(spark, d):
    """By the number of lists probed: how many of the ten nearest are found, for every vector whose id is divisible by 100."""
    v = t.table(spark, d, "embeddings")
    index = search_index.VectorLists.build(v, scratch(spark, "lists"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    path = scratch(spark, "exact")
    index.top_k_of_each(asked, 10, search_index.LISTS).select("query", "vec_id").write.parquet(path)
    exact, out = spark.read.parquet(path), None
    for probes in (1, 4, 16, 64, search_index.LISTS):
        found = exact if probes == search_index.LISTS else index.top_k_of_each(asked, 10, probes)
        hit = found.select("query", "vec_id", F.lit(1).alias("hit"))
        rows = exact.join(hit, ["query", "vec_id"], "left").agg(F.lit(probes).alias("probes"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"), F.count("*").alias("n_nearest"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT doc_id, round(ln(1 + (nd - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (nd - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (nd - de + 0.5) / (de + 0.5)) * e * 2.2 / (e + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE a + b + e > 0 ORDER BY score DESC, doc_id LIMIT 20", BM)
def keyword_topk(spark, d):
    """The same keyword ranking from an index of postings."""
    index = search_index.Postings.build(spread(t.table(spark, d, "documents").select("doc_id", "text")), scratch(spark, "postings"))
    return index.top_k("The ention, que", 20).select("doc_id", F.round("score", 6).alias("score"))


#: The namespace of ids that are made from a parent's scope, title and content.
PARENT_NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


@query(
    "+n AS (SELECT parent_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(tenant_id || '|' || kb_id || '|' || parent_id || '|' || sha256(lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))))) AS h FROM store)"
    " SELECT parent_id, h[1:12] || '5' || h[14:16] || substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:32] AS id FROM n",
    STORE,
)
def parent_name_ids(spark, d):
    """Ids of parents from their scope, title and content."""
    name = text.parent_name(F.col("tenant_id"), F.col("kb_id"), F.col("parent_id").cast("string"), F.col("content"))
    return t.parent_store(spark, d).select("parent_id", text.name_id(PARENT_NAMESPACE, name).alias("id"))


@query(
    "RECURSIVE +a AS (SELECT id, parent_id, CASE WHEN id % 17 = 0 THEN id END AS top FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.parent_id, coalesce(a.top, CASE WHEN t.id % 17 = 0 THEN t.id END) FROM tree t JOIN a ON t.parent_id = a.id),"
    " b AS (SELECT id, top, CASE WHEN top IS NULL AND id % 10 = 0 THEN id END AS second FROM a WHERE parent_id IS NULL UNION ALL SELECT a.id, a.top, coalesce(b.second, CASE WHEN a.top IS NULL AND a.id % 10 = 0 THEN a.id END) FROM a JOIN b ON a.parent_id = b.id),"
    " m AS (SELECT a.id, a.parent_id, CASE WHEN a.top IS NOT NULL THEN 'first:' || a.top WHEN b.second IS NOT NULL THEN 'second:' || b.second END AS was FROM a JOIN b USING (id)),"
    " n AS (SELECT id, parent_id, was, CASE WHEN was LIKE 'first:%' AND substr(was, 7)::BIGINT % 2 = 0 THEN NULL ELSE was END AS deleted_by FROM m),"
    " l AS (SELECT id, CASE WHEN deleted_by IS NULL THEN id END AS live FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, CASE WHEN n.deleted_by IS NULL THEN n.id ELSE l.live END FROM n JOIN l ON n.parent_id = l.id)"
    " SELECT n.id, CASE WHEN n.was IS NOT NULL AND n.deleted_by IS NULL THEN l.live ELSE n.parent_id END AS parent_id, n.deleted_by FROM n LEFT JOIN l ON l.id = n.parent_id",
    TREE,
)
def restored_pages(spark, d):
    """Pages after two deletions, and the half of the first one's taken back."""
    pages = t.tree(spark, d).select("id", "parent_id", F.lit(None).cast("string").alias("deleted_by"))
    pages = wiki.trashed(wiki.trashed(pages, F.col("id") % 17 == 0, "first"), F.col("id") % 10 == 0, "second")
    back = pages.where("deleted_by like 'first:%' and cast(substring(deleted_by, 7) as bigint) % 2 = 0").select("deleted_by")
    return wiki.restored(pages, back)


@query(
    "WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS tenant_id, p_type AS kb_id, p_name AS content, p_name AS title, p_type AS body FROM part),"
    " s AS (SELECT *, CASE WHEN tenant_id = '' THEN 'default' ELSE tenant_id END AS t FROM o),"
    " n AS (SELECT *, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(t || '|' || kb_id || '|' || lower(title) || '|' || sha256(lower(body)))) AS h FROM s)"
    " SELECT id, t AS tenant_id, kb_id, content, CASE WHEN id % 3 = 0 THEN 'p' || id ELSE h[1:12] || '5' || h[14:16] || substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:32] END AS parent_id, 1::BIGINT AS doc_version FROM n"
)
def migrated_rows(spark, d):
    """Rows of an old schema copied in pages into a new one, in two runs, of which the first stops half way."""
    old = t.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")).alias("tenant_id"), F.col("p_type").alias("kb_id"), F.col("p_name").alias("content"), F.col("p_name").alias("parent_title"), F.col("p_type").alias("parent_content"),
    )
    known = old.where("id % 3 = 0").select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("parent_id"))
    change = migration.with_parents(PARENT_NAMESPACE, known)
    m = migration.Migration(spark, scratch(spark, "migration"))

    def stop(page: int) -> None:
        if page == 2:
            raise InterruptedError

    try:
        m.copy(old, "id", change, 4, stop)
    except InterruptedError:
        m.copy(old, "id", change, 4)
    m.swap(old.count(), "part")
    return m.rows().select("id", "tenant_id", "kb_id", "content", "parent_id", "doc_version")


@query(
    "+o AS (SELECT *, id % 3 = 0 AND tenant_id <> 'de' AS one, id % 6 = 0 AS two FROM files)"
    " SELECT id, CASE WHEN id % 3 = 0 THEN 'de' ELSE tenant_id END AS tenant_id, CASE WHEN two THEN 'other' ELSE kb_id END AS kb_id, CASE WHEN two THEN 'guide' END AS category,"
    " CASE WHEN status = 'done' AND (one OR two) THEN 'chunked' ELSE status END AS status,"
    " CASE WHEN id % 12 = 0 THEN NULL WHEN one THEN tenant_id WHEN two THEN 'de' END AS previous_tenant_id, CASE WHEN id % 12 = 0 THEN NULL WHEN one OR two THEN kb_id END AS previous_kb_id FROM o",
    FILES,
)
def meta_edits(spark, d):
    """Files after two edits of their scopes, of which the first scope left is remembered, and clean-ups that clear it."""
    none = F.lit(None).cast("string")
    f = t.files(spark, d).select("id", "tenant_id", "kb_id", "status", none.alias("category"), none.alias("product_id"), none.alias("previous_tenant_id"), none.alias("previous_kb_id"))
    first = f.where("id % 3 = 0").select("id", none.alias("category"), none.alias("product_id"), F.lit("de").alias("tenant_id"), none.alias("kb_id"))
    second = f.where("id % 6 = 0").select("id", F.lit("guide").alias("category"), none.alias("product_id"), none.alias("tenant_id"), F.lit("other").alias("kb_id"))
    after = registry.edit_meta(registry.edit_meta(f, first), second)
    return registry.clear_previous(after, f.where("id % 12 = 0").select("id")).drop("product_id")


@query(
    "SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN 'raw ' || doc_id WHEN 1 THEN 'clean ' || doc_id WHEN 2 THEN '' ELSE md5(text) END AS markdown, CASE doc_id % 4 WHEN 0 THEN 'raw ' || doc_id ELSE md5(text) END AS raw_markdown,"
    " CASE WHEN doc_id % 4 = 2 THEN 'pending' ELSE 'done' END AS status, CASE doc_id % 4 WHEN 0 THEN 'edited' WHEN 3 THEN 'raw' ELSE 'cleaned' END AS clean_state, CASE WHEN doc_id % 4 = 3 THEN 'report' END AS clean_report, CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 2 END::BIGINT AS markdown_version FROM documents"
)
def markdown_edits(spark, d):
    """Conversions after edits of raw and cleaned texts, some of them empty."""
    k, own = F.col("doc_id"), F.md5("text")
    c = t.table(spark, d, "documents").select(
        k.alias("file_id"), own.alias("markdown"), own.alias("raw_markdown"), F.lit("done").alias("status"), F.lit("raw").alias("clean_state"), F.lit("report").alias("clean_report"), F.lit("1").alias("cleaner_version"), F.lit(1).cast("long").alias("markdown_version"),
    )
    f = F.col("file_id")
    edits = c.where(f % 4 < 3).select("file_id", F.when(f % 4 == 0, F.concat(F.lit("raw "), f.cast("string"))).when(f % 4 == 1, F.concat(F.lit("clean "), f.cast("string"))).alias("markdown"), F.when(f % 4 == 0, "raw").otherwise("cleaned").alias("target"))
    return registry.edit_markdown(c, edits).drop("cleaner_version")


@query(
    "+c AS (SELECT *, file_id % 3 <> 0 AS deduplicated FROM parents), again AS (SELECT DISTINCT b.file_id FROM c a JOIN c b ON a.tenant_id = b.tenant_id AND a.kb_id = b.kb_id AND a.parent_hash = b.parent_hash WHERE a.file_id % 10 = 0 AND NOT a.deduplicated AND b.deduplicated AND b.file_id % 10 <> 0)"
    " SELECT id, CASE WHEN id IN (SELECT file_id FROM again) THEN 'chunked' ELSE status END AS status, (SELECT count(*) FROM c WHERE c.file_id = files.id) AS n_parents FROM files WHERE id % 10 <> 0",
    FILES,
    PARENTS,
)
def deleted_files(spark, d):
    """Files and their parents left after every tenth file is deleted; those that left out what it alone served are to be published again."""
    c = t.parents(spark, d).withColumn("deduplicated", F.col("file_id") % 3 != 0)
    left, parents = registry.delete_files(t.files(spark, d), c, c.where("file_id % 10 = 0").select("file_id"))
    n = parents.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n_parents"))
    return left.select("id", "status").join(n, "id", "left").select("id", "status", F.coalesce("n_parents", F.lit(0)).alias("n_parents"))


@query(
    "+v AS (SELECT vec_id, label::BIGINT AS space_id, vec_id::VARCHAR AS source FROM embeddings), m AS (SELECT v.*, f.name FROM v JOIN files f ON f.id::VARCHAR = v.source WHERE space_id IN (1, 2, 3) AND contains(lower(f.name), 'doc-1'))"
    " SELECT vec_id, space_id, name AS source_name, (SELECT count(*) FROM m) AS total FROM m ORDER BY vec_id LIMIT 15 OFFSET 15",
    FILES,
)
def documents_by_name(spark, d):
    """The second page of the vectors of files with a name, with those names."""
    v = t.vectors(spark, d).withColumn("source", F.col("vec_id").cast("string"))
    return registry.documents_by_name(v, t.files(spark, d), " DOC-1", 2, 15, "vec_id", space_id=[1, 2, 3]).select("vec_id", "space_id", "source_name", "total")


@query("SELECT doc_id AS parent_id, substr(text, 1, 512) AS title, substr(source, 1, 128) AS category, substr(text, 1, 800) AS summary FROM documents")
def stored_parents(spark, d):
    """Parents as a store keeps them."""
    p = t.table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("title"), F.col("source").alias("category"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("content"))
    return registry.parent_rows(p).drop("content")


@query("SELECT vec_id FROM embeddings WHERE NOT coalesce(label = 2 AND vec_id < 900, false) AND vec_id % 11 <> 0")
def vector_delete(spark, d):
    """Vectors left after a deletion by an expression and one by ids."""
    v = t.vectors(spark, d)
    return vectors.deleted(v, all_of(equals(v, space_id=2, absent="x"), below(v, vec_id=900)), v.where("vec_id % 11 = 0")).select("vec_id")
