import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from revlake.llm import embeddings
from revlake.llm.graph import components


def brute(rows, threshold=0.9):
    ok = [(i, np.array(e, float)) for i, e in rows if e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    links = [0] * len(ok)
    for a, (i, x) in enumerate(ok):
        for b, (j, y) in enumerate(ok[:a]):
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    out = [(i, n, root(i), root(i) == i) for (i, _), n in zip(ok, links)]
    return out + [(i, 0, i, True) for i, e in rows if not any(e is o for o in [e for _, e in rows if e and all(v is not None and np.isfinite(v) for v in e) and any(e)])]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal((30, 24))
    for i in range(900):
        kind = i % 4
        v = base[0] + 0.02 * rng.standard_normal(24) if kind == 0 else base[i % 30] + rng.choice([0.1, 0.2, 0.3]) * rng.standard_normal(24) if kind == 1 else rng.standard_normal(24)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2002, None), (2003, [0.0] * 24), (2004, [float("nan")] * 24), (2005, [None] * 24), (2006, []), (2007, [1.0, 0.0]), (2008, [2.0, 0.1]), (2009, [float("inf")] + [1.0] * 23)]
    frame = spark.createDataFrame([(i, e, 1, "x", 3) for i, e in rows], "vec_id long, embedding array<float>, label int, key string, rep long")
    got = sorted(map(tuple, embeddings.near_duplicates(frame).collect()))
    expected = sorted(brute(rows))
    assert [g[0] for g in got] == [e[0] for e in expected]
    total = sum(e[1] for e in expected)
    assert sum(abs(g[1] - e[1]) for g, e in zip(got, expected)) <= 0.01 * total
    assert all(g[1] <= e[1] for g, e in zip(got, expected)) and [g[2:] for g in got] == [e[2:] for e in expected]
    again = sorted(map(tuple, embeddings.near_duplicates(frame.repartition(3)).collect()))
    assert again == got
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    k, l = embeddings.tables(64, 50_000, 0.9)
    met = embeddings.meet(embeddings.keys(a, k, l), embeddings.keys(0.9 * a + np.sqrt(0.19) * b, k, l)).any(1)
    assert met.mean() > 0.99, (k, l, met.mean())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
def test_components(spark, edges):
    got = dict(map(tuple, components(spark.createDataFrame(edges or [(1, 1)], "a long, b long"), "a", "b").collect()))
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (3, [1.0, 0.01, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (None, None), (9, [0.0, 0.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True)], key=key)
