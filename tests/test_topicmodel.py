import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlake.functions.expr import digamma
from revlake.operators import analysis, models, topicmodel


def psi(x, h=1e-5):
    return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)


def plain(words, topics, alpha, iterations, change):
    """Inference of one document, term by term."""
    k = len(alpha)
    totals = [sum(v[i] for v in topics.values()) for i in range(k)]
    beta = {t: [math.exp(psi(v[i]) - psi(totals[i])) for i in range(k)] for t, v in topics.items()}
    counts = {t: n for t, n in Counter(words or ()).items() if t in beta}
    gamma = [a + sum(counts.values()) / k for a in alpha] if counts else list(alpha)
    for _ in range(iterations if counts else 0):
        theta = [math.exp(psi(g) - psi(sum(gamma))) for g in gamma]
        new = [alpha[i] + sum(n * theta[i] * beta[t][i] / sum(theta[j] * beta[t][j] for j in range(k)) for t, n in counts.items()) for i in range(k)]
        moved = sum(abs(a - b) for a, b in zip(new, gamma)) / k
        gamma = new
        if moved < change:
            break
    return [g / sum(gamma) for g in gamma]


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    topics = {f"t{i}": [rng.random() * 20 + 0.05 for _ in range(3)] for i in range(25)}
    texts = [(i, [f"t{rng.randrange(30)}" for _ in range(rng.randrange(25))]) for i in range(60)] + [(90, None), (91, []), (92, ["unknown"]), (93, ["t1"] * 500)]
    return topics, texts, spark.createDataFrame(texts, "id int, words array<string>").repartition(3), spark.createDataFrame(list(topics.items()), "term string, weights array<double>")


@pytest.mark.parametrize("limit", [1000, 0])
def test_posterior_against_plain_inference(sample, limit):
    topics, texts, rows, table = sample
    alpha = [0.2, 0.5, 0.1]
    got = {r.id: r.weights for r in topicmodel.posterior(rows, "id", table, alpha, limit=limit).collect()}
    assert len(got) == len(texts)
    for i, words in texts:
        assert got[i] == pytest.approx(plain(words, topics, alpha, topicmodel.ITERATIONS, topicmodel.CHANGE), abs=1e-4)


def test_posterior_of_an_empty_table(sample):
    _, _, rows, table = sample
    assert topicmodel.posterior(rows.limit(0), "id", table, [0.1] * 3).count() == 0
    assert topicmodel.posterior(rows, "id", table.limit(0), [0.1, 0.3, 0.1]).first().weights == pytest.approx([0.2, 0.6, 0.2])


def test_digamma(spark):
    xs = [0.01, 0.3, 1.0, 2.5, 100.0]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(digamma(F.col("x"))).collect()] == pytest.approx([psi(x, x * 1e-5) for x in xs], abs=1e-4)


def brute_c_v(texts, topics, window):
    held, total = Counter(), 0
    words = {w for t in topics for w in t}
    for text in texts:
        for s in range(max(1, len(text) - window + 1)) if text else ():
            total += 1
            seen = sorted(set(text[s : s + window]) & words)
            held.update((a, b) for a in seen for b in seen)
    out = []
    for t in topics:
        v = {a: [math.log((held[a, b] / total + 1e-12) / (held[a, a] * held[b, b] / total**2)) / -math.log(held[a, b] / total + 1e-12) for b in t] for a in t}
        s = [sum(v[a][j] for a in t) for j in range(len(t))]
        out.append(sum(sum(x * y for x, y in zip(v[a], s)) / math.hypot(*v[a]) / math.hypot(*s) for a in t) / len(t))
    return out


@pytest.mark.parametrize("window", [1, 3, 7, 40])
def test_c_v_against_every_window(spark, window):
    rng = random.Random(window)
    texts = [[rng.choice("abcdefghijklmn") for _ in range(rng.randrange(40))] for _ in range(80)] + [None, [], ["a"] * 200]
    topics = [list("abcd"), list("aefg"), list("hi")]
    chosen = spark.createDataFrame([(t, r, w) for t, ws in enumerate(topics) for r, w in enumerate(ws, 1)], "topic int, rank int, term string")
    got = topicmodel.c_v(spark.createDataFrame(list(enumerate(texts)), "doc_id int, words array<string>").repartition(3), chosen, window)
    assert [r.c_v for r in got.orderBy("topic").collect()] == pytest.approx(brute_c_v([t or [] for t in texts], topics, window), abs=1e-5)


def test_fitted_topics_give_every_document_weights(spark):
    rng = random.Random(1)
    groups = [["kopi", "teh", "susu", "gula"], ["bus", "kereta", "mobil", "motor"]]
    texts = [(i, " ".join(rng.choice(groups[i % 2]) for _ in range(12))) for i in range(60)] + [(100, None), (101, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in models.lda_assignment(rows, 2, passes=20).collect()}
    assert len(got) == 62 and all(sum(r.weights) == pytest.approx(1) for r in got.values())
    assert {got[i].topic for i in range(0, 60, 2)} != {got[i].topic for i in range(1, 60, 2)} and all(len({got[i].topic for i in range(s, 60, 2)}) == 1 for s in (0, 1))
    flat = rows.sparkSession.createDataFrame([(1, [0.25] * 4)], "doc_id int, weights array<double>")
    assert analysis.dominant_topic(flat).first().topic == -1


def test_sweep_chooses_by_c_v(spark):
    means = spark.createDataFrame([(5, 0.5, -1.0), (6, 0.597, -2.0), (7, 0.6, -3.0), (8, 0.2, -1.0)], "k int, c_v double, u_mass double")
    assert [r.k for r in models.with_choice(means).collect() if r.chosen] == [6]
