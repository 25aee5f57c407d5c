import hashlib
import random

import numpy as np
import pytest

from quillspark.llm.simplex_clusters import Simplex, _squares, cluster, nearest, smallest_hashes, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string, apex string, distance string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "v", "a", "d", None) for i, v in rows], SCHEMA)


def brute(rows, k, dim, rounds=3):
    """By all distances in Python's integers: (vec_id, cluster, distance, own inertia, inertia, digest), in order."""
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in starts]
    for r in range(rounds + 1):
        far = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids] for _, v in kept]
        own = [d.index(min(d)) for d in far]
        for j in range(len(centroids) if r < rounds else 0):
            mine = [v for (_, v), a in zip(kept, own) if a == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [min(x) for x in far]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, a, x, sum(y for y, b in zip(d, own) if b == a), sum(d), digest[a]) for (i, _), a, x in zip(kept, own, d)]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("dim, k, n", [(64, 16, 300), (3, 4, 200), (1, 5, 60), (8, 16, 10)])
def test_like_all_distances(spark, dim, k, n):
    r = np.random.default_rng(dim)
    rows = [(i, (r.normal(size=dim) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(n)]
    assert same(cluster(table(spark, rows), k=k, dim=dim).collect(), brute(rows, k, dim))


def test_ties_and_repeats(spark):
    """A grid of few points, so that distances tie and starts are equal."""
    r = random.Random(4)
    rows = [(i % 40, [r.choice([-0.5, 0.0, 0.5]) for _ in range(2)]) for i in range(200)]
    assert same(cluster(table(spark, rows), k=9, dim=2).collect(), brute(rows, 9, 2))
    copies = [(i, [0.25, -0.75]) for i in range(50)]
    assert same(cluster(table(spark, copies), k=4, dim=2).collect(), brute(copies, 4, 2))


def test_odd_rows(spark):
    rows = [(1, [0.1, 0.2]), (2, None), (3, []), (4, [0.1, None]), (5, [0.1, float("nan")]), (6, [float("inf"), 0.0]), (7, [0.1]), (8, [0.0, 0.0]), (None, [5.0, 5.0]), (9, [-0.01, 0.01]), (9, [-0.01, 0.01])]
    got = cluster(table(spark, rows), k=2, dim=2).collect()
    assert same(got, brute(rows, 2, 2)) and {r["vec_id"] for r in got} == {1, 8, 9, None}
    assert cluster(table(spark, rows[1:3])).collect() == []
    assert cluster(table(spark, []).where("false")).collect() == []


def test_far_components_end_the_query(spark):
    with pytest.raises(Exception, match="64 bits"):
        cluster(table(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])]), k=1, dim=2).collect()


def test_bounds_hold():
    """Lower and upper bounds enclose the true distances, and few centroids are left where vectors lie near a plane."""
    r = np.random.default_rng(1)
    for rank in (2, 6, 64):
        x = np.floor(64 * (r.normal(size=(2000, rank)) @ r.normal(size=(rank, 64)))).astype(np.int64)
        simplex = Simplex(x[:27], 9)
        a, c = simplex.place(x), simplex.place(x[100:116])
        flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(2)
        true = np.sqrt(_squares(x, x[100:116]))
        slack = 1e-6 * true.max()
        assert (np.sqrt(flat + (a[:, None, -1] - c[None, :, -1]) ** 2) <= true + slack).all() and (np.sqrt(flat + (a[:, None, -1] + c[None, :, -1]) ** 2) >= true - slack).all()
        near, d, compared = nearest(x, a, x[100:116], c)
        assert (near == _squares(x, x[100:116]).argmin(1)).all() and (d == (true.min(1) ** 2).round()).all()
        assert rank > 6 or compared.mean() < 1.5


def test_flat_pivots_are_left_out(spark):
    assert len(Simplex(np.zeros((5, 3), np.int64)).pivots) == 1
    assert len(Simplex(np.array([[0, 0], [4, 0], [8, 0], [0, 4], [9, 9]])).pivots) == 3
    assert smallest_hashes(whole_vectors(table(spark, [(1, [1.0])]), 1), 1, 3).tolist() == [[64]]
