import hashlib
import math
import random

import numpy as np
import pytest

from revlake.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, `a.b` int, v int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2, 3, 4) for i, e in rows], SCHEMA).repartition(3)


def brute(rows, k=16, rounds=3):
    f = lambda x: float(np.float32(x))
    kept = [(i, [math.floor(64 * f(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(f(x)) for x in e)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            of = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if of:
                centroids[j] = [sum(x) // len(of) for x in zip(*of)]
    found = assign()
    long = lambda x: x if x < 1 << 63 else None
    inertia = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    return sorted((str(i), c, long(d), long(inertia[c]), long(sum(inertia)), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, found))


def compared(spark, rows):
    got = sorted((str(r[0]), *r[1:]) for r in clustering.report(frame(spark, rows)).collect())
    assert got == brute(rows)
    return got


def vectors(n, seed, scale=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, scale) for _ in range(64)] for _ in range(n)]


def test_against_brute_force(spark):
    rows = list(enumerate(vectors(300, 1, 0.125)))
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # a hot vector
    rows += [(3, rows[4][1]), (3, rows[3][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(500, None), (501, []), (502, [0.1] * 63), (503, [0.1] * 65), (504, [None] + [0.1] * 63), (505, [float("nan")] + [0.1] * 63), (506, [float("inf")] * 64), (507, [0.0] * 64)]
    assert len(compared(spark, rows)) == 300 + 120 + 4 + 1


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(60)]  # two points, 16 centroids
    assert len({r[1] for r in compared(spark, rows)}) == 2


def test_components_of_any_size(spark):
    rows = list(enumerate(vectors(40, 2))) + list(enumerate(vectors(10, 3, 1e6), 100)) + list(enumerate(vectors(10, 4, 3e7), 200)) + list(enumerate(vectors(10, 5, 1e30), 300)) + [(400, [-3.4e38] * 64)]
    assert any(r[2] is None for r in compared(spark, rows)) and any(r[2] is not None for r in compared(spark, rows))


def test_fewer_vectors_than_centroids(spark):
    assert len(compared(spark, list(enumerate(vectors(5, 6))))) == 5
    assert clustering.report(frame(spark, [])).count() == 0
    assert clustering.report(frame(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("scale", [8, 64, 1000])
def test_bounds_hold_and_screen(scale):
    rng = np.random.default_rng(scale)
    middle = rng.normal(0, scale, (16, 64))
    v = np.floor(middle[rng.integers(0, 16, 3000)] + rng.normal(0, scale, (3000, 64))).astype(np.int64)
    centroids = np.floor(middle).astype(np.int64)
    true = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (clustering.lower_bounds(v, clustering._norms(v), centroids) <= true).all()
    best, distance, n_exact = clustering.nearest(v, clustering._norms(v), centroids)
    assert (best == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert n_exact.mean() < 6
