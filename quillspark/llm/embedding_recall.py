"""Recall of operator 10's links, measured against all rows.

The tables at hand hold no two vectors within the threshold, so every tenth
vector gets three companions that Spark derives from it: the vector and a share
of itself, moved by one place, added up, which lie at cosines of about 0.91 to
0.93.  The links found for every vector whose id is divisible by 100, and for its
companions, are set against those of a comparison with all rows.

Queries are compared in blocks of at most BLOCK vectors, a job each.  Rows whose
vector links with nothing by definition have no links on either side; repeated
ids are no queries of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .embedding_graph import near_duplicates, rows_of, unit

#: Queries of a block, shares of the moved vector, and how far apart the ids of a vector and its companions are.
BLOCK, SHARES, STEP = 4096, (0.40, 0.44, 0.47), 10**12


def with_companions(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): all vectors, and three companions of each whose id is divisible by ten."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    out = rows
    for k, share in enumerate(SHARES):
        moved = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
        own = F.zip_with(v, moved, lambda x, y: x + F.lit(share) * y)
        out = out.unionByName(rows.where((F.col("vec_id") % 10 == 0) & (F.size(v) > 1)).select((F.col("vec_id") + (k + 1) * STEP).alias("vec_id"), own.alias("embedding")))
    return out


def true_links(rows: DataFrame, queries: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_true) of the queries, a part of ``rows``, by comparison with all of them."""

    def counter(ids: np.ndarray, q: np.ndarray):
        def run(batches):
            total = np.zeros(len(ids), np.int64)
            for b in batches:
                column = b.column("embedding")
                fits = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy() == q.shape[1])
                x = rows_of(column.take(pa.array(fits)))
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                for s in range(0, int(good.sum()), 1024):
                    total += (unit(x[good][s : s + 1024]) @ q.T >= least).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

        return run

    spark, out = rows.sparkSession, None
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    for block in range(2 * blocks):  # a hash deals them out, so a block is filled by half
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks)) == block).toArrow()
        v = part.column("embedding").to_pylist()
        for dim in sorted({len(x) for x in v if x}):
            own = [i for i, x in enumerate(v) if x and len(x) == dim and all(y is not None for y in x)]
            q = np.array([v[i] for i in own], float).reshape(len(own), dim)
            good = np.isfinite(q).all(1) & (q != 0).any(1)
            ids = part.column("vec_id").to_numpy()[own][good]
            if len(ids):
                counts = rows.mapInArrow(counter(ids, unit(q[good])), "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n_true"))  # without itself
                out = counts if out is None else out.unionByName(counts)
    return out if out is not None else spark.createDataFrame([], "vec_id long, n_true long")


def recall(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links (found by the graphs), n_true and recall of the queries: ids divisible by 100 and their companions."""
    rows = staged(with_companions(vectors), "companions")
    queries = staged(rows.where((F.col("vec_id") % STEP) % 100 == 0).dropDuplicates(["vec_id"]), "queries")
    found = near_duplicates(rows, least).select("vec_id", "n_links")
    both = staged(true_links(rows, queries, least), "links").join(found.dropDuplicates(["vec_id"]), "vec_id")
    return both.select("vec_id", "n_links", "n_true", F.when(F.col("n_true") > 0, F.col("n_links") / F.col("n_true")).otherwise(F.lit(1.0)).alias("recall"))
