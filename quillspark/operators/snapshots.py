"""Versioned tables as snapshots: upserts, soft deletes, patches and verified pointer swaps.

Parquet tables aren't changed in place.  An operation is a join that gives the
next snapshot; ``publish`` writes it beside the current one, verifies its rows
and only then commits a manifest that names it; the last manifest is current.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .manifests import Log


def upsert(old: DataFrame, new: DataFrame, keys: list[str], compare: str, version: str = "doc_version") -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; the version rises by one only where ``compare`` changed.

    ``new`` has the columns of ``old`` but for the version; new keys start at 1.
    """
    others = [c for c in old.columns if c not in keys and c != version]
    o = old.select(*keys, F.struct(*others, version).alias("_o"))
    n = new.select(*keys, F.struct(*others).alias("_n"))
    both = o.join(n, keys, "full_outer")
    value = lambda c: F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c)
    changed = F.col("_n").isNotNull() & ~F.col(f"_o.{compare}").eqNullSafe(F.col(f"_n.{compare}"))
    number = F.when(F.col("_o").isNull(), 1).when(changed, F.col(f"_o.{version}") + 1).otherwise(F.col(f"_o.{version}"))
    return both.select(*keys, *[value(c) for c in others], number.cast(old.schema[version].dataType).alias(version)).select(old.columns)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def soft_delete(rows: DataFrame, gone: Column, keep: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Status 'deleted' where ``gone`` holds, but for keys listed in ``keep``."""
    if keep is None:
        return rows.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status")))
    marked = keep.select(*keys).distinct().withColumn("_kept", F.lit(True))
    return rows.join(marked, keys, "left").withColumn("status", F.when(gone & F.col("_kept").isNull(), "deleted").otherwise(F.col("status"))).drop("_kept").select(rows.columns)


def patch(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of ``changes`` put into the rows of the same keys."""
    fields = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in fields])
    out = rows.join(renamed, keys, "left")
    return out.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def next_versions(current: DataFrame, target: DataFrame, *key: str) -> DataFrame:
    """(key, version to publish): 1 if absent, one more if the hash differs, else the same."""
    key = key or ("parent_id",)
    c = current.select(*key, F.col("content_sha256").alias("_sha"), F.col("doc_version").alias("_v"))
    v = F.when(F.col("_v").isNull(), 1).when(F.col("_sha").eqNullSafe(F.col("content_sha256")), F.col("_v")).otherwise(F.col("_v") + 1)
    return target.join(c, list(key), "left").select(*key, v.cast("long").alias("target_version"))


def publish(rows: DataFrame, path: str, expected: int | None = None) -> int:
    """Write the next snapshot, check its number of rows, and make it current; returns its number.

    Of two writers at once the second is refused when it comes to its number.
    """
    log = Log(rows.sparkSession, path)
    before = log.read()
    folder = log.write(rows, "snapshot")
    found = log.rows([folder], rows.schema).count()
    if expected is not None and found != expected:
        log.drop([folder])
        raise ValueError(f"the new snapshot has {found} rows instead of {expected}; the current one stays")
    return log.commit(before | {"snapshot": folder})["number"]


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{Log(spark, path).read()['snapshot']}")
