import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from revlake.llm import minhash

FLAT = np.ones(minhash.DF_BUCKETS)


def brute(rows, idf):
    """Components of equal texts and of texts with similarity from 0.8 up, all pairs compared."""
    features = {i: minhash.weighted(t, idf) for i, t in rows}
    texts = {i: t or "" for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(parent)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if texts[a] == texts[b] or len(features[a][0]) and len(features[b][0]) and minhash.similarity(features[a], features[b]) >= minhash.SIMILARITY:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "ing", "keit"], k=rng.randint(1, 4)))
    texts = []
    for k in range(25):
        base = [word() for _ in range(rng.choice([8, 60, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 25, len(base) // 8])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(300)]
    for k in range(30):  # each is near the next, the ends are far apart
        chain = list(chain)
        for j in range(3):
            chain[(10 * k + j) % 300] = word()
        texts.append(" ".join(chain))
    texts += ["", "", None, "one two", "one two", "ONE two", "one two three", "a b c d e", "x " * 30000, "x " * 30001]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes_match_brute_force(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows, minhash._idf(docs))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    kept = minhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got})


def test_odd_rows(make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "zz"), (3, None)])
    got = sorted(minhash.near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [tuple(r) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True), (None, None, True)]
    assert sorted(str(r.doc_id) for r in minhash.kept_documents(docs).collect()) == ["1", "3", "None", "None"]
    empty = make_docs([])
    assert minhash.near_duplicates(empty).collect() == [] and minhash.kept_documents(empty).collect() == []


def test_texts_of_one_id_are_compared_on_their_own(make_docs):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    docs = make_docs([(5, "quite another text than all the rest of them here"), (5, long), (2, long + "end"), (9, long)])
    got = sorted((r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 5, True), (9, 2, False)]
    assert sorted((r.doc_id, r.text[:5]) for r in minhash.kept_documents(docs).collect()) == [(2, "a b c"), (5, "quite")]


def test_a_large_group_of_distant_copies(make_docs, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]

    def copy(edits):
        out = list(base)
        for _ in range(edits):
            out[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        return " ".join(out)

    rows = [(i, copy(rng.choice([1, 2, 3, 3, 4, 5, 6]))) for i in range(500)]
    monkeypatch.setattr(minhash, "BLOCK", 64)  # several blocks a bucket
    compared = []
    step = minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda pairs, *more: compared.append(pairs.count()) or step(pairs, *more))
    docs = make_docs(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    expected = brute(rows, minhash._idf(docs))
    assert sum(got[i] != expected[i] for i in got) <= 1  # a miss has a probability of 2e-4 a link
    assert sum(compared) < 500 * 499 / 2 / 6  # pairs that were rows


def test_blocks_give_the_similarity():
    rng = np.random.default_rng(1)
    idf = rng.uniform(1, 1.1, minhash.DF_BUCKETS)
    texts = [" ".join(rng.choice(["a", "b", "c"], 80, p=[0.9, 0.05, 0.05])) for _ in range(9)] + ["x " * 300, "x " * 301, "p q"]
    for cut in (5, 12):
        found = minhash.shared_weights(texts, idf, cut)
        expected = [[minhash.similarity(minhash.weighted(a, idf), minhash.weighted(b, idf)) for b in texts[cut % 12 :]] for a in texts[:cut]]
        same = np.eye(12, dtype=bool)[:cut, cut % 12 :]  # a text with itself is not meant
        assert np.allclose(found[~same], np.array(expected)[~same])


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 1000), st.sampled_from([0.3, 0.6, 0.85]))
def test_samples_agree_as_often_as_texts_are_similar(seed, share):
    rng = np.random.default_rng(seed)
    n = 300
    common = int(n * share)
    f = rng.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
    a, b = np.sort(f[:n]), np.sort(np.concatenate([f[:common], f[n : 2 * n - common]]))
    w = dict(zip(f.tolist(), rng.uniform(0.5, 3, 2 * n)))
    wa, wb = (np.array([w[x] for x in s.tolist()]) for s in (a, b))
    j = minhash.similarity((a, wa), (b, wb))
    total, met = 0, 0
    for k in range(12):  # other seeds: other samples
        s = minhash.Sampler()
        s.seeds = np.random.default_rng([seed, k]).integers(1, 1 << 63, 36, dtype=np.uint64)
        keys, _ = s.bands(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, n]))
        met += (keys[0] == keys[1]).sum()
        total += 12
    assert abs(met / total - j**3) < 0.16
