"""A table copied into another schema page by page, so that a copy that stops goes on where it was.

Pages are ranges of the key.  A page is a folder of its own that a manifest takes
up when its rows have been counted; a run copies the pages that aren't there yet.
When all are, one manifest makes the copy current and keeps the old table's name
as the backup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import name_id, parent_name
from .manifests import Log

#: Keys that the bounds of pages are taken from, for each page.
SAMPLE = 200


def bounds(rows: DataFrame, key: str, pages: int) -> list:
    """``pages`` - 1 keys or fewer that cut the rows into pages of about equal size, from a bounded sample of keys."""
    n = rows.count()
    share = int(min(1.0, SAMPLE * pages / max(n, 1)) * (1 << 30))
    chosen = rows.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share)).select(key)
    keys = sorted(r[0] for r in chosen.limit(4 * SAMPLE * pages).collect())
    return sorted({keys[len(keys) * i // pages] for i in range(1, pages)}) if keys else []


class Migration:
    """``path`` holds the pages and the log; the manifest's ``current`` and ``backup`` name tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def copy(self, source: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], pages: int = 16, stop: Callable[[int], None] = lambda page: None) -> dict:
        """Copy the pages that are missing; ``change`` maps a page's rows, one for one.  ``stop`` is called before each page, for tests."""
        m = self.log.read()
        if "bounds" not in m:
            m = self.log.commit(m | {"bounds": bounds(source, key, pages), "pages": {}})
        edges = m["bounds"]
        for i in range(len(edges) + 1):
            if str(i) in m["pages"]:
                continue
            stop(i)
            own = source.where(self._within(F.col(key), edges, i))
            folder = self.log.write(change(own), "page")
            copied, wanted = self.spark.read.parquet(f"{self.log.path}/{folder}").count(), own.count()
            if copied != wanted:
                self.log.drop([folder])
                raise ValueError(f"page {i} has {copied} rows instead of {wanted}")
            m = self.log.commit(m | {"pages": m["pages"] | {str(i): {"folder": folder, "rows": copied}}})
        return m

    @staticmethod
    def _within(key: Column, edges: list, i: int) -> Column:
        """Keys of a page; null keys are in the first one."""
        above = key >= F.lit(edges[i - 1]) if i else F.lit(True)
        below = key < F.lit(edges[i]) if i < len(edges) else F.lit(True)
        within = above & below
        return F.coalesce(within, F.lit(i == 0)) if edges else within

    def swap(self, expected: int, old: str) -> dict:
        """Make the copy current if it has ``expected`` rows; ``old`` names the table that it replaces."""
        m = self.log.read()
        found = sum(p["rows"] for p in m["pages"].values())
        if len(m["pages"]) != len(m["bounds"]) + 1 or found != expected:
            raise ValueError(f"the copy has {found} rows instead of {expected}")
        return self.log.commit(m | {"current": [p["folder"] for p in m["pages"].values()], "backup": old})

    def rows(self) -> DataFrame:
        """The rows of the copy, once it is current."""
        m = self.log.read()
        if "current" not in m:
            raise ValueError("the copy isn't current")
        return self.spark.read.parquet(*[f"{self.log.path}/{f}" for f in m["current"]])


def with_parents(namespace: str, known: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Rows of the old schema (id, tenant_id, kb_id, content, parent_title, parent_content, ...) in the new one: the parent that
    ``known`` (id, parent_id) names, else one named by its scope, title and content; scopes have a default."""

    def change(rows: DataFrame) -> DataFrame:
        scope = [F.coalesce(F.nullif(F.substring(c, 1, 64), F.lit("")), F.lit("default")) for c in ("tenant_id", "kb_id")]
        named = name_id(namespace, parent_name(*scope, F.col("parent_title"), F.col("parent_content")))
        both = rows.join(known.select("id", F.nullif("parent_id", F.lit("")).alias("_known")).dropDuplicates(["id"]), "id", "left")
        keep = [c for c in rows.columns if c not in ("tenant_id", "kb_id", "parent_title", "parent_content")]
        return both.select(*keep, scope[0].alias("tenant_id"), scope[1].alias("kb_id"), F.coalesce("_known", named).alias("parent_id"), F.lit(1).cast("long").alias("doc_version"), F.lit(True).alias("is_current"))

    return change


def parents_of(rows: DataFrame, namespace: str, known: DataFrame) -> DataFrame:
    """The parents that rows of the old schema carry with them, one row each: of equal ones the longest content stays."""
    new = with_parents(namespace, known)(rows.withColumn("_title", F.col("parent_title")).withColumn("_content", F.col("parent_content")))
    held = new.where("_content <> ''").groupBy("tenant_id", "kb_id", "parent_id").agg(F.max(F.struct(F.length("_content").alias("n"), F.col("_content").alias("content"), F.coalesce("_title", F.lit("")).alias("title"))).alias("p"))
    return held.select("tenant_id", "kb_id", "parent_id", "p.title", "p.content", F.substring("p.content", 1, 800).alias("summary"))
