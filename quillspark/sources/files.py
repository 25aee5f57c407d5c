"""File sources and sinks: uploads, plain texts, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import extension, file_type

MOST_TEXT, MOST_IMAGE = 50 << 20, 10 << 20


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with hash, content-addressed name, type, and why one is refused (null: accepted)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", F.col("length").alias("size"), "content", extension(F.col("path")).alias("extension"), file_type(F.col("path")).alias("type"))
    return checked(rows).withColumn("sha256", F.sha2("content", 256)).withColumn("stored_name", F.concat("sha256", "extension"))


def checked(rows: DataFrame) -> DataFrame:
    """``refused`` from type and size."""
    return rows.withColumn("refused", F.when(F.col("type").isNull(), "extension").when((F.col("type") == "text") & (F.col("size") > MOST_TEXT), "size").when((F.col("type") == "image") & (F.col("size") > MOST_IMAGE), "size"))


def new_uploads(rows: DataFrame, known: DataFrame, scope: list[str], force: bool = False) -> DataFrame:
    """Uploads whose hash the scope doesn't have yet; all with ``force``."""
    return rows if force else rows.join(known.select(*scope, "sha256").distinct(), [*scope, "sha256"], "left_anti")


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of whole text files: trimmed, with one line break at the end; bad bytes become U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    made = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", F.concat(F.regexp_replace(made, r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def write_markdown(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Markdown as Parquet, by the columns of ``parts``."""
    rows.write.mode("overwrite").partitionBy(*parts).parquet(path)
