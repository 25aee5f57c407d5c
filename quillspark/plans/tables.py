"""The knowledge-base tables that queries run on, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import squeezed_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").otherwise("chunked")
    return d.join(l.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), (F.col("doc_id") % 500).cast("string"), F.lit(".md")).alias("name"), F.col("lang").alias("tenant_id"), F.col("source").alias("kb_id"),
        F.sha2("text", 256).alias("sha256"), status.alias("status"), (F.col("doc_id") * 7919 % 100000).alias("created_at"), F.col("n_chars").alias("size"),
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent for each document: the whole text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("tenant_id"), F.col("source").alias("kb_id"), squeezed_hash(F.col("text")).alias("parent_hash"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each line; four lines make a parent, every eleventh line has none."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    return d.select(
        "file_id", (F.col("file_id") * 100000 + F.col("i")).alias("seq"), F.when(F.col("i") % 11 != 10, F.concat_ws("-", F.col("file_id").cast("string"), F.floor(F.col("i") / 4).cast("string"))).alias("parent_id"),
        F.col("i").cast("long").alias("chunk_index"), "content", squeezed_hash(F.col("content")).alias("child_hash"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    k = F.col("conv_id")
    return c.select(
        k.alias("page_id"), F.concat(F.lit("page "), (k % 40).cast("string")).alias("title"), F.concat(F.lit("p-"), k.cast("string")).alias("slug"), (k % 8).alias("space_id"),
        F.when(k % 3 == 0, "draft").otherwise("published").alias("status"), F.when(k % 10 == 0, k).alias("deleted_at"), (F.col("last") - k % 2).alias("current_revision_id"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("conv_id"), F.col("turn")
    text = F.concat(F.col("text"), F.lit(" [[page "), ((k * 7 + t) % 60).cast("string"), F.lit("]] [[ p-"), (k + 1).cast("string"), F.lit(" ]]"))
    return table(spark, sf_dir, "conversations").select(k.alias("page_id"), t.alias("revision_id"), text.alias("content_md"))


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(k < 8).select(k.cast("long").alias("space_id"), F.when(k % 4 == 0, "public").otherwise("private").alias("visibility"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users: a role in the space of their number."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("user_id"), (k % 8).alias("space_id"), F.when(k % 3 == 0, "owner").when(k % 3 == 1, "editor").otherwise("reader").alias("role"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.nullif(F.floor(k / 3), F.lit(0)).cast("long").alias("parent_id"), (k % 17 == 0).alias("mark"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("space_id"), (k % 5 != 0).alias("is_current"))


def parent_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("tenant_id"), F.col("p_type").alias("kb_id"), k.alias("parent_id"), F.col("p_name").alias("content"), F.sha2("p_name", 256).alias("content_sha256"),
        F.when(k % 9 == 0, "deleted").otherwise("active").alias("status"), F.col("p_size").cast("long").alias("doc_version"), (k % 21 == 0).alias("deduplicated"),
    )


def parent_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New contents: a third of the parents, half of them unchanged, and some new ones."""
    k = F.col("parent_id")
    old = parent_store(spark, sf_dir).drop("doc_version")
    some = old.where(k % 3 == 0).withColumn("content", F.when(k % 6 == 0, F.concat("content", F.lit(" revised"))).otherwise(F.col("content")))
    new = old.where(k % 50 == 0).withColumn("parent_id", k + 1000000)
    return some.unionByName(new).withColumn("content_sha256", F.sha2("content", 256)).withColumn("status", F.lit("active"))


def parent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("parent_id")
    p = parent_store(spark, sf_dir).select("tenant_id", "kb_id", "parent_id", "doc_version")
    v = p.where(k % 7 != 0).withColumn("doc_version", F.col("doc_version") - F.when(k % 5 == 0, 1).otherwise(0)).withColumn("kb_id", F.when(k % 11 == 0, "moved").otherwise(F.col("kb_id")))
    o = p.where(k % 13 == 0).withColumn("parent_id", k + 2000000)
    return v.unionByName(o).withColumn("file_id", F.col("parent_id") % 1000000).withColumn("vector_id", F.concat_ws(":", F.col("parent_id").cast("string"), F.col("doc_version").cast("string"))).withColumn("is_current", F.col("parent_id") % 19 != 0)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("job_id"), F.col("event_type").alias("state"), F.col("ts").alias("updated_at"))
