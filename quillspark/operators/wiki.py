"""Wiki relations: revisions, trees, links, access and trash."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import wiki_links
from ..plans.lineage import cut
from .vectors import top_k

WRITERS = ["owner", "editor"]


def published_pairs(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """(page_id, revision_id) that readers see: published, not deleted, and the revision is there."""
    p = pages.where("status = 'published' and deleted_at is null").select("page_id", F.col("current_revision_id").alias("revision_id"))
    return p.join(revisions.select("page_id", "revision_id").distinct(), ["page_id", "revision_id"])


def latest(revisions: DataFrame) -> DataFrame:
    """The newest revision of each page, with its text."""
    return revisions.groupBy("page_id").agg(F.max_by("content_md", "revision_id").alias("content_md"), F.max("revision_id").alias("revision_id"))


def next_revision(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    n = revisions.groupBy("page_id").agg(F.max("revision_id").alias("_m"))
    return pages.select("page_id").join(n, "page_id", "left").select("page_id", (F.coalesce("_m", F.lit(0)) + 1).cast("long").alias("next_revision"))


def climb(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, marked) of a forest given as (id, parent_id, mark): ``marked`` if the node or any ancestor is.

    Pointers are doubled, so a tree of depth d takes about log2(d) joins; a
    parent that doesn't exist makes a root.
    """
    ids = nodes.select(F.col("id").alias("parent_id"))
    known = nodes.where("parent_id is not null").join(ids, "parent_id", "left_semi").select("id", F.col("parent_id").alias("up"))
    t = cut(nodes.join(known, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("mark", F.lit(False)).alias("marked")))
    last = -1
    while True:
        over = t.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("marked").alias("_m"))
        t = cut(t.join(over, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("depth") + F.when(F.col("up") == F.col("id"), 0).otherwise(F.col("_d"))).alias("depth"), (F.col("marked") | F.col("_m")).alias("marked")))
        now = t.agg(F.sum("depth")).first()[0]
        if now == last:
            return t.withColumnRenamed("up", "root")
        last = now


def link_rows(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, target, to_page): links of the newest texts, resolved by title, else by slug, within the space; else forward."""
    home = pages.select("page_id", "space_id")
    found = latest(revisions).join(home, "page_id").select("page_id", "space_id", F.explode(wiki_links(F.col("content_md"))).alias("target"))
    named = [pages.groupBy("space_id", F.col(c).alias("target")).agg(F.min("page_id").alias(f"_{c}")) for c in ("title", "slug")]
    return found.join(named[0], ["space_id", "target"], "left").join(named[1], ["space_id", "target"], "left").select("page_id", "target", F.coalesce("_title", "_slug").alias("to_page"))


def backlinks(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, from_page) of resolved links, once each, from pages that aren't deleted."""
    live = pages.where("deleted_at is null").select(F.col("page_id").alias("from_page"))
    return links.where("to_page is not null").select(F.col("to_page").alias("page_id"), F.col("page_id").alias("from_page")).distinct().join(live, "from_page", "left_semi").select("page_id", "from_page")


def may(role: Column, visibility: Column, need: str) -> Column:
    """Whether a role suffices to ``read`` or ``write`` a space."""
    writes = F.coalesce(role.isin(WRITERS), F.lit(False))
    return writes if need == "write" else writes | F.coalesce(role == "reader", F.lit(False)) | F.coalesce(visibility == "public", F.lit(False))


def accessible(spaces: DataFrame, members: DataFrame, user_id: int, need: str = "read") -> DataFrame:
    """space_id that the user may use."""
    own = members.where(F.col("user_id") == user_id).select("space_id", "role")
    return spaces.join(own, "space_id", "left").where(may(F.col("role"), F.col("visibility"), need)).select("space_id")


def search(vectors: DataFrame, query: list[float], k: int, pages: DataFrame, revisions: DataFrame, spaces: DataFrame, space_id: int | None = None, text: str | None = None, offset: int = 0) -> DataFrame:
    """Top-k among published revisions of accessible spaces; filters come before ranking, titles after."""
    rows = vectors.join(published_pairs(pages, revisions), ["page_id", "revision_id"], "left_semi").join(spaces, "space_id", "left_semi")
    if space_id is not None:
        rows = rows.where(F.col("space_id") == space_id)
    if text:
        rows = rows.where(F.contains(F.lower("content"), F.lower(F.lit(text))))
    best = top_k(rows, query, k, offset)
    return best.join(pages.select("page_id", "title"), "page_id", "left")


def line_diff(old: Column, new: Column) -> Column:
    """array<struct<op, text>>: lines that are 'equal', 'delete' or 'insert'; a replacement is its deletions, then its insertions."""

    def one(a: str | None, b: str | None) -> list[dict]:
        x, y, out = (a or "").splitlines(), (b or "").splitlines(), []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y).get_opcodes():
            if tag == "equal":
                out += [{"op": tag, "text": t} for t in x[i:j]]
            else:
                out += [{"op": "delete", "text": t} for t in x[i:j]] + [{"op": "insert", "text": t} for t in y[k:m]]
        return out

    @F.pandas_udf("array<struct<op:string,text:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return run(old, new)


def recovered(pages: DataFrame, revisions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pages stuck in publishing, with their ``latest`` revision and new status: published where it has vectors, else draft.

    ``pages`` are the stale ones; a page without revisions becomes a draft.
    """
    newest = revisions.groupBy("page_id").agg(F.max("revision_id").alias("latest"))
    there = vectors.select("page_id", F.col("revision_id").alias("latest")).distinct().withColumn("_there", F.lit(True))
    found = pages.join(newest, "page_id", "left").join(there, ["page_id", "latest"], "left")
    return found.select(*[c for c in pages.columns if c != "status"], "latest", F.when(F.col("_there"), "published").otherwise("draft").alias("status"))


def keep_revision(vectors: DataFrame, keep: DataFrame) -> DataFrame:
    """Vectors without those of the pages in ``keep`` (page_id, revision_id) that belong to other revisions; a null revision keeps none."""
    k = keep.select("page_id", F.col("revision_id").alias("_kept"), F.lit(True).alias("_known"))
    rows = vectors.join(k, "page_id", "left")
    return rows.where(F.col("_known").isNull() | F.coalesce(F.col("revision_id") == F.col("_kept"), F.lit(False))).select(vectors.columns)


def purged(nodes: DataFrame, gone: Column) -> DataFrame:
    """A forest (id, parent_id) of pages or comments without the nodes where ``gone`` holds and all below them."""
    marks = climb(nodes.select("id", "parent_id", gone.alias("mark"))).where("not marked").select("id")
    return nodes.join(marks, "id", "left_semi")


def newest_revisions(revisions: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest revisions of each page.  Only their numbers are ranked, not their texts, and each task keeps ``n`` a page."""
    newest = Window.partitionBy("page_id").orderBy(F.desc("revision_id"))
    numbers = revisions.select("page_id", "revision_id").distinct().withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n).drop("_place")
    return revisions.join(numbers, ["page_id", "revision_id"], "left_semi")


def _topmost(nodes: DataFrame) -> DataFrame:
    """(id, top): for nodes (id, parent_id, mark) that lie at or below a marked one, the topmost marked node above them.

    Pointers are doubled as in ``climb``.
    """
    ids = nodes.select(F.col("id").alias("parent_id"))
    known = nodes.where("parent_id is not null").join(ids, "parent_id", "left_semi").select("id", F.col("parent_id").alias("up"))
    t = nodes.join(known, "id", "left").select("id", "up", F.when(F.col("mark"), F.col("id")).alias("top"))
    t = cut(t)
    while t.where("up is not null").take(1):
        over = t.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        t = cut(t.join(over, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")))
    return t.where("top is not null").select("id", "top")


def trashed(pages: DataFrame, gone: Column, deletion: str) -> DataFrame:
    """``pages`` after the pages where ``gone`` holds went to the trash with all that lies below them.

    ``pages`` have id, parent_id and deleted_by, null for live ones.  A live page
    is marked with the deletion and the topmost page that took it; pages that an
    earlier deletion took keep their mark.
    """
    taken = _topmost(pages.select("id", "parent_id", (F.coalesce(gone, F.lit(False)) & F.col("deleted_by").isNull()).alias("mark")))
    mark = F.concat(F.lit(f"{deletion}:"), F.col("top").cast("string"))
    return pages.join(taken, "id", "left").withColumn("deleted_by", F.coalesce("deleted_by", mark)).select(pages.columns)


def restored(pages: DataFrame, deletions: DataFrame) -> DataFrame:
    """``pages`` after the given deletions (deleted_by) were taken back: what they took returns, and nothing else.

    A page that comes back below one that stays in the trash hangs below its
    nearest live ancestor, or at the top where there is none.
    """
    back = deletions.select("deleted_by").distinct().withColumn("_back", F.lit(True))
    after = cut(pages.join(back, "deleted_by", "left").withColumn("deleted_by", F.when(F.col("_back"), None).otherwise(F.col("deleted_by"))))
    # pointers of deleted pages are doubled until each points to a live page or to none
    up = cut(after.where("deleted_by is not null").select("id", F.col("parent_id").alias("up")))
    while True:
        over = up.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        longer = up.join(over, F.col("up") == F.col("_id"))
        if not longer.take(1):
            break
        up = cut(up.join(over, F.col("up") == F.col("_id"), "left").select("id", F.when(F.col("_id").isNotNull(), F.col("_up")).otherwise(F.col("up")).alias("up")))
    dead = up.select(F.col("id").alias("parent_id"), F.col("up").alias("_live"), F.lit(True).alias("_dead"))
    hung = after.join(dead, "parent_id", "left")
    return hung.withColumn("parent_id", F.when(F.col("_back") & F.col("_dead"), F.col("_live")).otherwise(F.col("parent_id"))).select(pages.columns)
