"""Listings: filters, pages, counts and the composites that pages are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import all_of, equals, holds_text


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) in ``order``, which should end in a unique column; planned as a top-k, not a full sort."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def files(files_: DataFrame, text: str | None = None, **equal) -> DataFrame:
    """Files under conjunctive filters; ``text`` is searched in the name."""
    return files_.where(all_of(equals(files_, **equal), holds_text("name", text)))


def newest(rows: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    return page(rows, [F.desc("created_at"), F.asc("id")], number, size)


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def with_counts(page_: DataFrame, chunks: DataFrame, conversions: DataFrame) -> DataFrame:
    """A page of files with its numbers of chunks and clean states; both sides are reduced to the page's files first."""
    ids = page_.select(F.col("id").alias("file_id"))
    n = chunks.join(F.broadcast(ids), "file_id", "left_semi").groupBy("file_id").agg(F.count("*").alias("n_chunks"))  # a page has a fixed size
    state = conversions.join(F.broadcast(ids), "file_id", "left_semi").select("file_id", clean_state().alias("clean_state"))
    return page_.join(n, page_["id"] == n["file_id"], "left").drop("file_id").join(state, page_["id"] == state["file_id"], "left").drop("file_id").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("clean_state", F.coalesce("clean_state", F.lit("none")))


def clean_state() -> Column:
    """Edited before cleaned before raw."""
    return F.when(F.col("edited"), "edited").when(F.col("cleaned"), "cleaned").otherwise("raw")


def chunk_tree(chunks: DataFrame, live: DataFrame, staged: DataFrame) -> DataFrame:
    """Parents with their children in order.  A parent's text is the live one, else the staged one, else its children joined."""
    parents = chunks.groupBy("file_id", "parent_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("children"),
        F.count("*").alias("n_children"),
        F.round(F.avg(F.length("content")), 1).alias("mean_size"),
    )
    joined = F.array_join(F.transform("children", lambda c: c["content"]), "\n\n")
    one = live.select("parent_id", F.col("content").alias("_live"))
    two = staged.select("parent_id", F.col("content").alias("_staged"))
    return parents.join(one, "parent_id", "left").join(two, "parent_id", "left").withColumn("content", F.coalesce("_live", "_staged", joined)).drop("_live", "_staged")


def merge_chunks(chunks: DataFrame, keys: list[str], merged: Column) -> DataFrame:
    """Of each group of ``keys`` the rows where ``merged`` holds become one, at the lowest index, their texts joined by blank lines."""
    one = chunks.where(merged).groupBy(*keys).agg(F.min("chunk_index").alias("chunk_index"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n").alias("content"))
    return chunks.where(~F.coalesce(merged, F.lit(False))).select(*keys, "chunk_index", "content").unionByName(one)


def page_with_total(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page, each row with the number of all ``rows``."""
    return page(rows, order, number, size).withColumn("total", F.lit(rows.count()))


def delete_cascade(parents: DataFrame, gone: Column, key: str, children: DataFrame, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those that are ``gone``, and children without the children of those."""
    lost = parents.where(gone).select(F.col(key).alias("_lost")).distinct()
    return parents.where(~F.coalesce(gone, F.lit(False))), children.join(lost, F.col(child_key) == F.col("_lost"), "left_anti")


def edit_chunks(chunks: DataFrame, edits: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks without those in ``gone`` (seq), and with the texts of ``edits`` (seq, content), each seq once."""
    new = edits.select("seq", F.col("content").alias("_new"))
    left = chunks.join(gone.select("seq").distinct(), "seq", "left_anti").join(new, "seq", "left")
    return left.withColumn("content", F.coalesce("_new", "content")).select(chunks.columns)
