import math
import random
import zlib
from collections import Counter

import numpy as np

from revlake.llm import brown


def test_exchange_moves_raise_the_likelihood_as_computed():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 3, 40)
    rate = np.array([[9, 1, 1], [1, 1, 9], [1, 9, 1]])
    pairs = rng.poisson(rate[truth][:, truth]).astype(float)
    start = brown.exchange(pairs, 4, 0)
    last = brown.likelihood(pairs, start)
    for sweeps in (1, 2, 5):
        now = brown.likelihood(pairs, brown.exchange(pairs, 4, sweeps))
        assert now >= last - 1e-6
        last = now
    of = brown.exchange(pairs, 4, 20)
    for w in range(39):  # no single move is better
        for c in range(4):
            other = of.copy()
            other[w] = c
            assert brown.likelihood(pairs, other) <= brown.likelihood(pairs, of) + 1e-6


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(5)
    pairs = rng.poisson(3, (30, 30)).astype(float)
    of = np.append(rng.integers(0, 4, 29), 4)
    member = np.eye(5)[of]
    right, left = (pairs @ member), (pairs.T @ member)
    codes, ns, start = [], [], [0]
    for w in range(29):
        entries = [(c, n) for c, n in enumerate([*right[w], *left[w]]) if n]
        codes += [c for c, _ in entries]
        ns += [n for _, n in entries]
        start.append(len(codes))
    got = brown.gains(member.T @ pairs @ member, of[:29], np.array(start), np.array(codes), np.array(ns), np.diag(pairs)[:29].copy())
    now = brown.likelihood(pairs, of)
    for w in range(29):
        for c in range(4):
            other = of.copy()
            other[w] = c
            assert abs(brown.likelihood(pairs, other) - now - (got[w, c] - got[w, of[w]])) < 1e-6


def test_words_beyond_the_seeds_move_on_their_own_counts(make_docs, monkeypatch):
    """Words with one ending but different neighbours part; nothing but a seed set was moved before."""
    monkeypatch.setattr(brown, "ITEMS", 8)
    monkeypatch.setattr(brown, "END", 8 + brown.ENDINGS)
    monkeypatch.setattr(brown, "CLASSES", 5)
    monkeypatch.setattr(brown, "COMMON", 12)  # most words take the join
    rng = random.Random(3)
    pick = lambda seeds, rare: rng.choice(seeds) if rng.random() < 0.6 else f"{rare}{rng.randint(0, 20)}end"
    rows = [(i, " ".join(" ".join((rng.choice(["the", "a"]), pick(["dog", "cat"], "n"), pick(["runs", "eats"], "v"), rng.choice(["fast", "well"]))) for _ in range(5))) for i in range(300)]
    counts, m = brown.fit(make_docs(rows).select("doc_id", "text"))
    of = {bytes(r.word).decode(): r["class"] for r in counts.collect()}
    assert len({brown.ending(w.encode()) for w in of if w.endswith("end")}) == 1
    nouns, verbs = ({of[w] for w in of if w[0] == k and w.endswith("end")} for k in "nv")
    assert not nouns & verbs
    # Each word beyond the seeds has the class that a plain evaluation of all classes finds.
    lines = [[None, *text.encode().lower().split()] for _, text in rows]
    order = sorted({w for x in lines for w in x[1:]}, key=lambda w: (-sum(x.count(w) for x in lines), w))
    seeds, k = order[:8], brown.CLASSES + 1
    first = lambda w: brown.CLASSES if w is None else int(m.classes[seeds.index(w) if w in seeds else brown.ending(w)])
    tokens = [w for x in lines for w in x] + [None]
    names = [None, *order]
    count = np.zeros((len(names), len(names)))
    for a, b in zip(tokens, tokens[1:]):
        count[names.index(a), names.index(b)] += 1
    start = np.array([first(w) for w in names])
    for w in [w for w in order[8:] if count[names.index(w)].sum() >= brown.LEAST][:10]:
        worth = []
        for c in range(brown.CLASSES):
            other = start.copy()
            other[names.index(w)] = c
            member = np.eye(k)[other]
            worth.append(brown.likelihood(member.T @ count @ member, np.arange(k)))
        assert worth[of[w.decode()]] > max(worth) - 1e-5
    # Scores take the moved classes.
    got = {r.doc_id: r for r in brown.score(make_docs(rows)).collect()}
    counts, m = brown.fit(make_docs([r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]).select("doc_id", "text"))
    table = {bytes(r.word).decode(): (r.n, r["class"]) for r in counts.collect()}
    for i, text in rows[:20]:
        line = [brown.CLASSES, *(table[w][1] for w in text.split()), brown.CLASSES]
        expected = sum(m.transition[x, y] - m.emission_total[y] for x, y in zip(line, line[1:])) + sum(math.log10(table[w][0] + brown.ADD) for w in text.split())
        assert abs(got[i].score - expected) < 1e-6


def corpus():
    rng = random.Random(2)
    kinds = [["the", "a"], ["dog", "cat", "bird", "fish"], ["runs", "eats", "sings"], ["fast", "well."]]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice(k) if rng.random() < 0.9 else f"rare{rng.randint(0, 400)}" for k in kinds]
        rows.append((i, " ".join(words).replace("dog", rng.choice(["dog", "Dog", "DOG"]))))
    return rows + [(7, "the dog"), (None, "the cat é É"), (400, None), (401, ""), (402, "zzz " * 2000)]


def test_scores(make_docs, monkeypatch):
    monkeypatch.setattr(brown, "COMMON", 30)  # so that most words take the join
    monkeypatch.setattr(brown, "HELD", 50)
    rows = corpus()
    got = brown.score(make_docs(rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda ws: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
    expected = Counter((i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + 1, n, round(base(words(t)), 6)) for i, t in rows)
    assert Counter((*r[:5], round(r.base_score, 6)) for r in got) == expected
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out) and all(r.score < 0 for r in out)


def test_model_is_a_distribution(spark, make_docs):
    docs = make_docs(corpus()).select("doc_id", "text")
    counts, m = brown.fit(docs)
    table = {bytes(r.word): (r.n, r["class"]) for r in counts.collect()}
    assert np.allclose((10**m.transition).sum(1), 1)
    mass = np.zeros(brown.CLASSES + 1)
    for n, c in table.values():
        mass[c] += n + brown.ADD
    used = mass > 0
    assert (mass[used] / 10 ** m.emission_total[used] <= 1).all() and (mass[used] / 10 ** m.emission_total[used] > 0.5).all()


def test_empty(make_docs):
    assert brown.score(make_docs([])).collect() == []
    assert len(brown.score(make_docs([(2, None), (3, "")])).collect()) == 2
