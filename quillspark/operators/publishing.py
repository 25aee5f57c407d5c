"""Publish targets, job states, and the reconciliation of parents with vectors, all as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRIPLE = ["tenant_id", "kb_id", "parent_id"]
SCOPE = ["tenant_id", "kb_id"]


def rebuilt_parents(chunks: DataFrame) -> DataFrame:
    """Parents put together again from their chunks in order."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("file_id", "parent_id").agg(parts.alias("_parts")).select("file_id", "parent_id", F.array_join(F.transform("_parts", lambda c: c["content"]), "\n\n").alias("content"), F.size("_parts").cast("long").alias("n_chunks"))


def published_scopes(current: DataFrame, previous: DataFrame, recorded: DataFrame) -> DataFrame:
    """Scopes where a file may have published: its current, its previous and those recorded, nulls left out."""
    cols = ["file_id", *SCOPE]
    return current.select(cols).union(previous.select(cols)).union(recorded.select(cols)).where("tenant_id is not null and kb_id is not null").distinct()


def superseded(vectors: DataFrame, scopes: DataFrame, keep: DataFrame) -> DataFrame:
    """Vectors of the given files and scopes that the last publish didn't write."""
    return vectors.join(scopes.select("file_id", *SCOPE).distinct(), ["file_id", *SCOPE], "left_semi").join(keep.select("vector_id").distinct(), "vector_id", "left_anti")


def reconcile(parents: DataFrame, vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Differences between the parent store and the vector table as (problem, tenant_id, kb_id, parent_id).

    missing: an active parent that was not left out as a duplicate has no current vector;
    stale: a vector's version is below its parent's; orphan: a current vector has no active parent;
    stale_scope: a vector lies in another scope than its file.
    """
    active = parents.where("status = 'active'").select(*TRIPLE, "doc_version", "deduplicated")
    v = vectors.where("is_current").groupBy(*TRIPLE).agg(F.min("doc_version").alias("_v"))
    both = active.join(v, TRIPLE, "full_outer").withColumn(
        "problem",
        F.when(F.col("doc_version").isNull(), "orphan").when(F.col("_v").isNull() & ~F.col("deduplicated"), "missing").when(F.col("_v") < F.col("doc_version"), "stale"),
    )
    home = files.select("file_id", F.col("tenant_id").alias("_t"), F.col("kb_id").alias("_k"))
    moved = vectors.where("is_current").join(home, "file_id").where((F.col("tenant_id") != F.col("_t")) | (F.col("kb_id") != F.col("_k"))).select(F.lit("stale_scope").alias("problem"), *TRIPLE).distinct()
    return both.where("problem is not null").select("problem", *TRIPLE).unionByName(moved)


def latest_jobs(log: DataFrame, key: str = "file_id", at: str = "updated_at", tie: str = "job_id") -> DataFrame:
    """The last entry of each key of an append-only log, ties by the greater id."""
    rest = [c for c in log.columns if c not in (key, at, tie)]
    return log.groupBy(key).agg(F.max(F.struct(at, tie, *rest)).alias("_j")).select(key, "_j.*")


def stale(jobs: DataFrame, now: Column, seconds: int, states: list[str], at: str = "updated_at") -> DataFrame:
    """Jobs in one of ``states`` that weren't touched for so long; one clock, UTC."""
    return jobs.where(F.col("state").isin(states) & (F.col(at) < now - F.make_dt_interval(secs=F.lit(seconds))))


def recovered(rows: DataFrame, fallback: dict[str, str], now: Column, seconds: int, at: str = "updated_at") -> DataFrame:
    """States of stale rows put back to what each falls back to; others as they are."""
    back = F.create_map(*[F.lit(x) for pair in fallback.items() for x in pair])
    old = F.col(at) < now - F.make_dt_interval(secs=F.lit(seconds))
    return rows.withColumn("state", F.when(old, F.coalesce(F.try_element_at(back, "state"), "state")).otherwise(F.col("state")))


def converted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Conversions after new texts came in: the version rises and the clean state is lost only if the text changed.

    ``old``: file_id, raw, cleaned, version; ``new``: file_id, raw.
    """
    both = old.join(new.select("file_id", F.col("raw").alias("_raw")), "file_id", "full_outer")
    same = F.col("_raw").isNull() | F.col("raw").eqNullSafe(F.col("_raw"))
    version = F.when(F.col("version").isNull(), 1).when(same, F.col("version")).otherwise(F.col("version") + 1)
    return both.select("file_id", F.coalesce("_raw", "raw").alias("raw"), F.when(same, F.col("cleaned")).alias("cleaned"), version.cast("long").alias("version"))


def mark_cleaned(conversions: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Conversions after a cleaning: the first raw text stays, and the version rises only if the text changed.

    ``conversions``: file_id, markdown, raw, clean_state, version; ``cleaned``: file_id, markdown, source.
    """
    new = cleaned.select("file_id", F.col("markdown").alias("_m"), F.col("source").alias("_s"), F.lit(True).alias("_hit"))
    both = conversions.join(new, "file_id", "left")
    rises = F.col("_hit").isNotNull() & ~F.col("markdown").eqNullSafe(F.col("_m"))
    take = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old)).alias(old)
    return both.select("file_id", take(F.col("_m"), "markdown"), take(F.coalesce("raw", "_s"), "raw"), take(F.lit("cleaned"), "clean_state"), (F.col("version") + rises.cast("long")).alias("version"))


def edit_conversions(conversions: DataFrame, edits: DataFrame) -> DataFrame:
    """Conversions after edits by hand: of the raw text, which ends any cleaning, or of the cleaned one; the version rises.

    ``edits``: file_id, markdown, target ('raw' or 'cleaned').
    """
    both = conversions.join(edits.select("file_id", F.col("markdown").alias("_m"), F.col("target").alias("_t")), "file_id", "left")
    hit, raw = F.col("_t").isNotNull(), F.col("_t") == "raw"
    state = F.when(raw, "edited").when(hit, "cleaned").otherwise(F.col("clean_state"))
    return both.select("file_id", F.when(hit, F.col("_m")).otherwise(F.col("markdown")).alias("markdown"), F.when(raw, F.col("_m")).otherwise(F.col("raw")).alias("raw"), state.alias("clean_state"), (F.col("version") + hit.cast("long")).alias("version"))


def delete_in_scopes(parents: DataFrame, scopes: DataFrame, tenant_id: str, kb_id: str, keep: DataFrame) -> DataFrame:
    """Parents of the given scopes become 'deleted'; those listed in ``keep`` stay, but only in the current scope.

    Ids repeat across scopes when content is unchanged, so what the current scope keeps mustn't hold elsewhere.
    """
    marked = scopes.where("tenant_id <> '' and kb_id <> ''").select(*SCOPE).distinct().withColumn("_scope", F.lit(True))
    kept = keep.select("parent_id").distinct().withColumn("_keep", F.lit(True))
    own = (F.col("tenant_id") == tenant_id) & (F.col("kb_id") == kb_id)
    gone = F.col("_scope").isNotNull() & ~(own & F.col("_keep").isNotNull())
    both = parents.join(marked, SCOPE, "left").join(kept, "parent_id", "left")
    return both.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).select(parents.columns)


#: Fixed value: characters of an error that a job keeps.
ERROR_CHARS = 2000


def update_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after updates by job_id: the state is set, null fields of an update leave what was there, errors are cut.

    ``jobs``: job_id, state, indexed_chunks, last_error, retry_count and others; ``updates``: job_id (once each), state,
    indexed_chunks, error, retry (whether the count of retries rises).
    """
    new = updates.select("job_id", F.col("state").alias("_state"), F.col("indexed_chunks").alias("_n"), F.col("error").alias("_error"), F.col("retry").alias("_retry"))
    value = {
        "state": F.coalesce("_state", "state"),
        "indexed_chunks": F.coalesce("_n", "indexed_chunks"),
        "last_error": F.coalesce(F.substring("_error", 1, ERROR_CHARS), "last_error"),
        "retry_count": F.col("retry_count") + F.coalesce(F.col("_retry"), F.lit(False)).cast("long"),
    }
    return jobs.join(new, "job_id", "left").select(*[value[c].alias(c) if c in value else F.col(c) for c in jobs.columns])
