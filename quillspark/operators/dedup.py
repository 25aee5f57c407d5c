"""Content-fingerprint deduplication.

Hot fingerprints are no hot tasks: firsts are found by partially aggregated
minima and joined back on the fingerprint and the order, which is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SCOPE = ["tenant_id", "kb_id"]


def flag_first(rows: DataFrame, keys: list[str], order: str, flag: str = "is_first") -> DataFrame:
    """``flag``: whether the row has the least ``order`` of its keys; null keys are keys like others."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first")).select(F.col("_first")).distinct()
    return rows.join(first, F.col(order) == F.col("_first"), "left").withColumn(flag, F.col("_first").isNotNull()).drop("_first")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each group of equal keys the row of the least ``order``, which must be unique in the table."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first.select("_first"), F.col(order) == F.col("_first"), "left_semi")


def served_elsewhere(parents: DataFrame, served: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Parents whose fingerprint another finished file of the same scope serves.

    ``parents``: scope, file_id, parent_hash; ``served``: scope, owner (a file), parent_hash.
    """
    owners = served.groupBy(*scope, "parent_hash").agg(F.min("owner").alias("_least"), F.max("owner").alias("_most"))
    found = parents.join(owners, [*scope, "parent_hash"])
    return found.where((F.col("_least") != F.col("file_id")) | (F.col("_most") != F.col("file_id"))).select(parents.columns)


def fresh_parents(parents: DataFrame, served: DataFrame, scope: list[str] = SCOPE, order: str = "seq") -> DataFrame:
    """The parents to publish: the first of each fingerprint in its file, unless another finished file of the scope serves it."""
    owners = served.groupBy(*scope, "parent_hash").agg(F.min("owner").alias("_least"), F.max("owner").alias("_most"))
    firsts = keep_first(parents, [*scope, "file_id", "parent_hash"], order)
    found = firsts.join(owners, [*scope, "parent_hash"], "left")
    return found.where(F.col("_least").isNull() | ((F.col("_least") == F.col("file_id")) & (F.col("_most") == F.col("file_id")))).select(parents.columns)


def fresh_children(children: DataFrame, order: str = "seq") -> DataFrame:
    """The first of each fingerprint within its parent; rows without a parent are each their own group."""
    return keep_first(children.withColumn("_group", F.coalesce("parent_id", F.concat(F.lit("row:"), F.col(order).cast("string")))), ["file_id", "_group", "child_hash"], order).drop("_group")


def dependents(removed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that left out chunks because of a removed file: they hold a deduplicated chunk of its scope and fingerprint.

    ``removed``: scope, file_id, parent_hash of what it had published; ``chunks``: scope, file_id, parent_hash, deduplicated.
    """
    gone = removed.select(*SCOPE, "parent_hash", F.col("file_id").alias("owner")).distinct()
    return chunks.where("deduplicated").join(gone, [*SCOPE, "parent_hash"]).where("file_id != owner").select("file_id").distinct()


def first_owner(files: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """For each content hash of a scope with several files: the oldest file and how many there are."""
    return files.groupBy(*scope, "sha256").agg(F.min(F.struct("created_at", "id"))["id"].alias("first_id"), F.count("*").alias("n_files")).where("n_files > 1")


def renumbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``name`` counts the rows of each key from 0, in ``order``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long") - 1)
