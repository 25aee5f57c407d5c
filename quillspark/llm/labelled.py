"""Labelled rows to learn from: a bounded sample by hash, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_bucket


def sample_labels(labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """(label_id, y) of labelled rows where ``learn`` holds: all, or about ``most`` of them, chosen by a hash of doc_id.

    Rows without an id or a label are left out, and repeated ones count once.  The
    result has a proven bound and so may be broadcast: the hash keeps most/count
    of the rows.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn).select(F.col("doc_id").cast("long").alias("label_id"), F.col(column).cast("int").alias("y")).distinct()
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return rows


def balanced_labels(labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """(label_id, y, w) of at most about ``most`` labelled rows, half of them of either label where there are enough.

    Rows are chosen by a hash of doc_id, repeated ones counting once; w is how many
    rows each stands for.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn).select(F.col("doc_id").cast("long").alias("label_id"), (F.col(column) > 0).cast("int").alias("y")).distinct()
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    few = min(n.values(), default=0)
    room = {y: min(c, max(most // 2, most - few)) for y, c in n.items()}
    rate = F.coalesce(*[F.when(F.col("y") == y, F.lit(room[y] / c)) for y, c in n.items()], F.lit(1.0))
    chosen = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < (rate * (1 << 30)))
    return chosen.withColumn("w", 1 / rate)


def learns(modulus: int, held: int) -> Column:
    return crc_bucket("doc_id", modulus) != held


def held_out(modulus: int, held: int) -> Column:
    return F.coalesce(crc_bucket("doc_id", modulus) == held, F.lit(False))


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Documents of the sample with y; the sample is broadcast, so texts aren't shuffled."""
    return docs.join(F.broadcast(sample), docs["doc_id"] == sample["label_id"])
