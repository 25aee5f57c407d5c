"""Operator 12: centroid clustering of integer vectors, centroids filtered by an N-simplex projection.

A few pivots are taken from the vectors.  Their mutual distances make a simplex;
a point's distances to them place it as an apex over that simplex.  Between two
apexes the plain Euclidean distance is a lower bound of the true distance, and
with one altitude turned over it is an upper bound.

1. Components become integers and each vector's distances to the pivots are
   turned into apex coordinates once; both are written and read by every round.
2. A round broadcasts the centroids (K of them, whatever the table) with their
   apex coordinates.  A vector keeps the centroids whose lower bound isn't over
   its least upper bound, and those alone are compared in exact integers.
3. Sums and counts of a cluster are added up in each task, then by cluster and
   component in Spark: K x DIM numbers reach the driver, which divides them.

Bounds are floating-point and compared with a margin far over their error, so
they decide only what isn't compared, never what is nearest.

Defined results: vectors that are null, of other than ``dim`` components, or
hold a null or non-finite one aren't kept and give no row; a null vec_id is kept
but never starts a cluster; repeated rows count as vectors each, also as starts
(equal hashes in order of their components); fewer than K vectors start fewer
clusters; ties in distance go to the smaller number; an empty table gives an
empty result.  A component beyond 2^27 after scaling, whose squared distances
could leave 64 bits, ends the query with an error.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import staged

K, DIM, ROUNDS, PIVOTS, SCALE = 16, 64, 3, 9, 64
#: Largest absolute component; vectors compared at once; share of the largest distance that bounds may err by; least altitude of a pivot over the others, by the same measure.
MOST, AT_ONCE, SLACK, FLAT = 1 << 27, 8192, 1e-6, 0.05


def whole_vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of long floor(scale * x)."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size(x) == dim) & finite)
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def smallest_hashes(rows: DataFrame, salt: int, n: int) -> np.ndarray:
    """The n vectors with the smallest sha256 of ``salt:vec_id``, in that order."""
    hashed = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(n).collect()], np.int64)


class Simplex:
    """A base of pivots, from the distances between them alone."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS):
        """Pivots that stand clear over those before them; equal or flat ones are left out."""
        self.pivots = candidates[:1].astype(np.int64)
        self.base = np.zeros((len(self.pivots), 0))
        for p in candidates[1:]:
            if len(self.pivots) == most:
                break
            d = _squares(p[None], self.pivots)
            apex = self._apex(d)
            if apex[0, -1] > FLAT * np.sqrt(d.max(initial=1)):
                self.pivots = np.vstack([self.pivots, p])
                self.base = np.vstack([np.pad(self.base, ((0, 0), (0, 1))), apex])

    def _apex(self, d: np.ndarray) -> np.ndarray:
        """Coordinates over the base, the altitude last, of points at squared distances ``d`` to the pivots."""
        d = d.astype(float)
        n = len(self.pivots)
        out = np.zeros((len(d), n))
        if n > 1:
            b = self.base[1:]
            right = (d[:, :1] - d[:, 1:] + (b * b).sum(1)) / 2
            for i in range(n - 1):
                out[:, i] = (right[:, i] - out[:, :i] @ b[i, :i]) / b[i, i]
        out[:, -1] = np.sqrt(np.maximum(0, d[:, 0] - (out * out).sum(1))) if n else 0
        return out

    def place(self, v: np.ndarray) -> np.ndarray:
        return self._apex(_squares(v, self.pivots)) if len(self.pivots) else np.zeros((len(v), 1))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to the few rows of ``b``."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        x = a - row
        out[:, j] = np.einsum("ij,ij->i", x, x)
    return out


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids compared exactly) of each vector."""
    flat = ((apex[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(2)
    lower = np.sqrt(flat + (apex[:, None, -1] - tops[None, :, -1]) ** 2)
    upper = np.sqrt(flat + (apex[:, None, -1] + tops[None, :, -1]) ** 2)
    margin = SLACK * (np.abs(apex).max(1) + np.abs(tops).max() + 1)
    open_ = lower <= (upper.min(1) + margin)[:, None]
    best, cluster = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
    for j in range(len(centroids)):
        rows = np.flatnonzero(open_[:, j])
        d = _squares(v[rows], centroids[j : j + 1])[:, 0]
        nearer = d < best[rows]
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], j
    return cluster, best, open_.sum(1)


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def placed(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """(vec_id, v, apex) of whole vectors, as packed numbers."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                if np.abs(v).max(initial=0) > MOST:
                    raise ValueError(f"a component is beyond {MOST} after scaling; its distances may not fit 64 bits")
                apex = simplex.place(v)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in (v.astype("<i4"), apex)]], ["vec_id", "v", "apex"])

    return rows.mapInArrow(run, "vec_id long, v binary, apex binary")


def _assigned(batches, simplex: Simplex, centroids: np.ndarray):
    tops = simplex.place(centroids)
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            part = b.slice(at, AT_ONCE)
            v = _matrix(part.column("v"), "<i4").astype(np.int64)
            yield part.column("vec_id"), v, *nearest(v, _matrix(part.column("apex"), "<f8"), centroids, tops)


def assign(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance and the number of centroids that were compared exactly."""

    def run(batches):
        for ids, _, cluster, d, compared in _assigned(batches, simplex, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(d), pa.array(compared.astype(np.int32))], ["vec_id", "cluster", "distance", "compared"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long, compared int")


def moved(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means, empty clusters unchanged."""
    k, dim = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, v, cluster, _, _ in _assigned(batches, simplex, centroids):
            for j in np.unique(cluster).tolist():
                own = v[cluster == j]
                total[j] += own.sum(0)
                count[j] += len(own)
        j = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(count[j]), pa.array(total[j].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = table.mapInArrow(run, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("i", "x"))
    found = sums.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # k x dim rows at most
        out[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    return out


def cluster(rows: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and compared (centroids compared exactly) of every kept vector."""
    spark: SparkSession = rows.sparkSession
    whole = whole_vectors(rows, dim, scale)
    centroids = smallest_hashes(whole, 1, k).reshape(-1, dim)
    # three times as many candidates, for those that are equal or lie flat
    simplex = Simplex(smallest_hashes(whole, 2, 3 * pivots).reshape(-1, dim), pivots)
    if not len(centroids):  # no vec_id at all: nothing can start a cluster
        centroids = np.zeros((1, dim), np.int64)
    if np.abs(centroids).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} after scaling; its distances may not fit 64 bits")
    table = staged(placed(whole, simplex), "apexes")
    for _ in range(rounds):
        centroids = moved(table, simplex, centroids)
    found = staged(assign(table, simplex, centroids), "clusters")
    sums = {r["cluster"]: r["own"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each = [(j, sums[j], sum(sums.values()), digests[j]) for j in sorted(sums)]
    each = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
