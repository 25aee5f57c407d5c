"""What the operators of this folder share: the shared scratch folder, staged tables, null handling, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset (local tests) a temporary
    folder is made and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and
    a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a null text as the empty one; other columns don't travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch, most_bytes: int = 4 << 20, column: str = "text"):
    """Parts of an Arrow batch whose texts take at most so many bytes together; a longer text is a part of its own.

    Arrow batches are bounded by rows and by
    ``spark.sql.execution.arrow.maxBytesPerBatch``; this bounds what the
    functions here hold beside a batch, however long its texts are.
    """
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at, before = to, int(sizes[to - 1])
    give_back()  # workers outlive their tasks


def give_back() -> None:
    """Return to the system what Python has freed, in the driver or a worker: else the arrays a model was made of stay with the
    C library's allocator and count as the driver's memory through all later steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def crc_bucket(doc_id: str, n: int):
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: (node, component), the smallest reachable id, for all other nodes than that one.

    Alternates the large-star and small-star steps until the links are stars:
    each greater end has one link, and no lesser end is a greater one too.  That
    is asked before a step, in one aggregation, so links that are stars already
    take none.  Every step is a partially aggregated minimum and an equi-join
    that adaptive execution can split, so a hub with very many links doesn't sit
    in one task; only a count reaches the driver.
    """
    links = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def unsettled(x: DataFrame) -> int:
        ends = x.select(F.col("a").alias("node"), "b").union(x.select("b", F.lit(None).cast(x.schema["b"].dataType)))
        # the row of a lesser end has no b
        of = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("center"))
        return of.agg(F.count_if((F.col("low") != F.col("high")) | (F.col("center") & F.col("low").isNotNull()))).first()[0]

    rounds = 0
    while unsettled(links):
        if rounds == most_rounds:
            raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
        rounds += 1
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every greater neighbour is hung below the least one
        big = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: the smaller neighbours and the node itself are hung below the least one
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        links = staged(small, "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
