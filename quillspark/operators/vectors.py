"""Vector tables: exact cosine top-k under filters, pages, upserts, purges, keyword ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import all_of, current, equals
from ..plans.lineage import cut
from .listing import page


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine in double precision, on the JVM; null for a zero vector or another dimension."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = v.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((F.size(v) == len(query)) & (norm > 0) & F.lit(size > 0), dot / (norm * F.lit(size)))


def top_k(vectors: DataFrame, query: list[float], k: int, offset: int = 0, where: Column | None = None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest under ``where``, which is applied before ranking; ties go to the lesser key."""
    rows = vectors.where(all_of(current(vectors), where)).withColumn("score", cosine(F.col(column), query)).where("score is not null")
    return page(rows.drop(column), [F.desc("score"), F.asc(key)], 1, offset + k).offset(offset) if offset else page(rows.drop(column), [F.desc("score"), F.asc(key)], 1, k)


def documents(vectors: DataFrame, number: int, size: int, key: str, **equal) -> DataFrame:
    """A page of scalar columns under the filters that the table's schema knows."""
    scalars = [f.name for f in vectors.schema if f.dataType.typeName() != "array"]
    return page(vectors.where(equals(vectors, **equal)).select(*scalars), [F.asc(key)], number, size)


def deleted(vectors: DataFrame, where: Column | None = None, ids: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """Vectors left after those where the condition holds (a condition that is null for a row doesn't), and those listed by
    ``key``, are deleted.  Neither given, all stay."""
    left = vectors if where is None else vectors.where(~F.coalesce(where, F.lit(False)))
    return left if ids is None else left.join(ids.select(key).distinct(), key, "left_anti").select(vectors.columns)


def purge(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors of no removed file: by id, and by name for old rows without one, if only one file has the name.

    ``files``: file_id, name, n_same_name.
    """
    by_id = vectors.join(files.select("file_id"), "file_id", "left_anti")
    named = files.where("n_same_name = 1").select(F.col("name").alias("source_name"), F.lit("").alias("file_id"))
    return by_id.join(named, (by_id["source_name"] == named["source_name"]) & (F.coalesce(by_id["file_id"], F.lit("")) == named["file_id"]), "left_anti")


def bm25(docs: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Top-k by BM25.  Term frequencies are counted inside each row, so the texts aren't shuffled."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    wanted = sorted({t.lower() for t in terms})
    rows = docs.select(key, F.array_remove(words, "").alias("w")).select(key, F.size("w").alias("n"), *[F.size(F.filter("w", _same(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])
    rows = cut(rows)  # a few numbers a row, so that texts are split once
    s = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(wanted))]).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        df, tf = s[f"df{i}"] or 0, F.col(f"tf{i}")
        idf = F.log(F.lit(1 + (s["docs"] - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(s["mean"] or 1.0)))
    return page(rows.select(key, score.alias("score")).where("score > 0"), [F.desc("score"), F.asc(key)], 1, k)


def _same(term: str):
    return lambda x: x == term


def stats(vectors: DataFrame, *keys: str) -> DataFrame:
    """Rows, current rows and the range of sizes by key."""
    size = F.size("embedding")
    return vectors.groupBy(*keys).agg(F.count("*").alias("n_vectors"), F.sum(F.col("is_current").cast("long")).alias("n_current"), F.min(size).alias("least_size"), F.max(size).alias("most_size"))
