"""Files and what hangs on them: edits that remember where old data lies, deletions with those who depend, claims, an audit trail.

Every change is a join that gives the next state of a table; nothing is updated row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import dedup, listing
from .manifests import Conflict, Log

#: Characters that a parent's title and category, and a summary, keep.
TITLE_CHARS, CATEGORY_CHARS, SUMMARY_CHARS = 512, 128, 800
META = ["category", "product_id", "tenant_id", "kb_id"]


def set_status(files: DataFrame, updates: DataFrame) -> DataFrame:
    """``files`` after updates (id, status), once each; other files stay."""
    return files.join(updates.select("id", F.col("status").alias("_status")), "id", "left").withColumn("status", F.coalesce("_status", "status")).select(files.columns)


def edit_meta(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``files`` after edits of their category, product or scope (id and META, nulls leaving what is there).

    The scope that a file leaves first is kept as previous_tenant_id and
    previous_kb_id until it is cleared, as that is where its published data
    lies, however often it moves.  A finished file that changed is to be
    published again.
    """
    new = edits.select("id", *[F.col(c).alias(f"_{c}") for c in META])
    both = files.join(new, "id", "left")
    moves = [F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in META]
    leaves = (moves[2] | moves[3]) & (F.coalesce("previous_tenant_id", F.lit("")) == "")
    value = {c: F.coalesce(f"_{c}", c) for c in META}
    value |= {f"previous_{c}": F.when(leaves, F.col(c)).otherwise(F.col(f"previous_{c}")) for c in ("tenant_id", "kb_id")}
    value["status"] = F.when((F.col("status") == "done") & (moves[0] | moves[1] | moves[2] | moves[3]), "chunked").otherwise(F.col("status"))
    return both.select(*[value[c].alias(c) if c in value else F.col(c) for c in files.columns])


def clear_previous(files: DataFrame, done: DataFrame) -> DataFrame:
    """``files`` without the previous scope of those in ``done`` (id), whose clean-up has succeeded."""
    both = files.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    gone = {c: F.when(F.col("_done").isNull(), F.col(c)) for c in ("previous_tenant_id", "previous_kb_id")}
    return both.select(*[gone[c].alias(c) if c in gone else F.col(c) for c in files.columns])


def edit_markdown(conversions: DataFrame, edits: DataFrame) -> DataFrame:
    """``conversions`` after edits (file_id, markdown, target): of the raw text, which becomes the source and ends any cleaning,
    or of the cleaned one, which keeps the raw text.  Either way the version rises, what a cleaner reported is forgotten, and
    an empty text waits."""
    both = conversions.join(edits.select("file_id", F.coalesce("markdown", F.lit("")).alias("_m"), F.col("target").alias("_t")), "file_id", "left")
    hit, raw = F.col("_t").isNotNull(), F.col("_t") == "raw"

    def after(new: Column, old: str, when: Column = hit) -> Column:
        return F.when(when, new).otherwise(F.col(old))

    value = {
        "markdown": after(F.col("_m"), "markdown"), "raw_markdown": after(F.col("_m"), "raw_markdown", F.coalesce(raw, F.lit(False))), "status": after(F.when(F.col("_m") == "", "pending").otherwise("done"), "status"),
        "clean_state": after(F.when(raw, "edited").otherwise("cleaned"), "clean_state"), "clean_report": after(F.lit(None), "clean_report"), "cleaner_version": after(F.lit(None), "cleaner_version"), "markdown_version": F.col("markdown_version") + hit.cast("long"),
    }
    return both.select(*[value[c].cast(conversions.schema[c].dataType).alias(c) if c in value else F.col(c) for c in conversions.columns])


def depending(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(file_id) of other files that left out parents as duplicates of those in ``ids`` (file_id): they are to be published again.

    ``chunks``: file_id, tenant_id, kb_id, parent_hash, deduplicated.
    """
    of = chunks.join(ids.select("file_id").distinct(), "file_id", "left_semi").where("not deduplicated")
    return dedup.dependents(of, chunks).join(ids.select("file_id").distinct(), "file_id", "left_anti")


def after_edits(files: DataFrame, chunks: DataFrame, edited: DataFrame) -> DataFrame:
    """``files`` after the texts of ``edited`` (file_id) changed: these are to be cut again, files that depend on them to be
    published again."""
    again = depending(chunks, edited).select(F.col("file_id").alias("id"), F.lit("chunked").alias("status"))
    own = edited.select(F.col("file_id").alias("id"), F.lit("converted").alias("status")).distinct()
    return set_status(files, again.unionByName(own))


def delete_files(files: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and chunks after the deletion of ``gone`` (file_id), those who depend on them found first."""
    again = depending(chunks, gone).select(F.col("file_id").alias("id"), F.lit("chunked").alias("status"))
    left = set_status(files, again)
    ids = gone.select("file_id").distinct()
    return left.join(ids.withColumnRenamed("file_id", "id"), "id", "left_anti"), chunks.join(ids, "file_id", "left_anti")


def documents_by_name(vectors: DataFrame, files: DataFrame, name: str, number: int, size: int, key: str, **equal) -> DataFrame:
    """A page of a vector table's scalar columns for files whose name holds ``name``, each with ``source_name`` and the ``total``.

    ``vectors`` has source, a file's id; a source that is no file is its own name.
    All files that match count, however many there are.
    """
    from ..functions.predicates import equals

    rows = vectors.select(*[f.name for f in vectors.schema if f.dataType.typeName() != "array"]).where(equals(vectors, **equal))
    named = files.select(F.col("id").cast("string").alias("_source"), F.col("name").alias("_name"))
    both = rows.join(named, F.col("source").cast("string") == F.col("_source"), "left")
    if name.strip():
        both = both.where(F.contains(F.lower("_name"), F.lower(F.lit(name.strip()))))
    out = both.withColumn("source_name", F.coalesce("_name", F.col("source").cast("string"))).drop("_source", "_name")
    return listing.page_with_total(out, [F.asc(key)], number, size)


def parent_rows(parents: DataFrame) -> DataFrame:
    """``parents`` with their titles, categories and summaries cut to what a store keeps; without a summary the content's beginning."""
    cut = {"title": F.substring("title", 1, TITLE_CHARS), "category": F.substring("category", 1, CATEGORY_CHARS), "summary": F.substring(F.coalesce("summary", "content"), 1, SUMMARY_CHARS)}
    return parents.select(*[cut[c].alias(c) if c in cut else F.col(c) for c in parents.columns])


class Claims:
    """Who works on what: a key is given to one holder until it is released, whoever asks at the same time."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path)

    def claim(self, holder: str, keys: list[str], tries: int = 5) -> list[str]:
        """Those of ``keys`` that were free; the others belong to another holder."""
        for left in range(tries, 0, -1):
            m = self.log.read()
            held = m.get("held", {})
            free = [k for k in dict.fromkeys(keys) if held.get(k, holder) == holder]
            try:
                if free:
                    self.log.commit(m | {"held": held | dict.fromkeys(free, holder)})
                return free
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def release(self, holder: str, keys: list[str]) -> None:
        """Give up keys; those of other holders stay theirs."""
        self.log.update(lambda m: m | {"held": {k: h for k, h in m.get("held", {}).items() if not (k in keys and h == holder)}})

    def held(self) -> dict[str, str]:
        return self.log.read().get("held", {})


AUDIT = "at timestamp, actor string, action string, target_type string, target_id string, detail string, day date"


def append_audit(rows: DataFrame, path: str) -> None:
    """Add (at, actor, action, target_type, target_id, detail, a struct or map) to an audit trail, a partition a day."""
    kept = rows.select("at", "actor", "action", "target_type", F.col("target_id").cast("string").alias("target_id"), F.to_json("detail").alias("detail"), F.to_date("at").alias("day"))
    kept.write.mode("append").partitionBy("day").parquet(path)


def audit(spark: SparkSession, path: str, since: Column | None = None, number: int = 1, size: int = 50, **equal) -> DataFrame:
    """A page of the trail, the newest first; days before ``since``, a date, aren't read."""
    from ..functions.predicates import all_of, equals

    rows = spark.read.schema(AUDIT).parquet(path)
    return listing.page(rows.where(all_of(None if since is None else F.col("day") >= since, equals(rows, **equal))), [F.desc("at"), F.asc("target_id"), F.asc("action")], number, size)
