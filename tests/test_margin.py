import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.operators import margin, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = [(i, " ".join(rng.choice(words[(i % 3) * 10 : (i % 3) * 10 + 40], rng.integers(1, 25))), int(i % 3 == 0)) for i in range(150)]
    texts += [(900, "", 1), (901, None, 0), (902, "unknown", 0)]
    return models.terms(spark.createDataFrame(texts, "doc_id long, text string, label int").repartition(3)).persist()


def dense(rows, model):
    index = {t: i for i, t in enumerate(model.terms)}
    x, y = [], []
    for r in rows.orderBy("doc_id").collect():
        v = np.zeros(len(index) + 1)
        v[-1] = 1
        for t in set(r.terms):
            if t in index:
                v[index[t]] = (1 + np.log(r.terms.count(t))) * model.idf[index[t]]
        norm = np.sqrt((v[:-1] ** 2).sum())
        v[:-1] /= norm or 1
        x.append(v)
        y.append(2 * r.label - 1)
    return np.array(x), np.array(y, float)


def optimum(x, y, cost, c=1.0):
    """Newton's method with whole matrices."""
    w = np.zeros(x.shape[1])
    value = lambda w: w @ w / 2 + c * (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(100):
        miss = 1 - y * (x @ w)
        on = miss > 0
        g = w - 2 * c * x.T @ (cost * y * np.where(on, miss, 0))
        h = np.eye(len(w)) + 2 * c * (x[on] * cost[on, None]).T @ x[on]
        way, t = np.linalg.solve(h, -g), 1.0
        while value(w + t * way) > value(w) + 1e-4 * t * (g @ way) and t > 1e-9:
            t /= 2
        w = w + t * way
    return w, value


def test_objective_is_within_a_ten_thousandth_of_the_least(rows):
    model = models.margin_model(rows, min_df=2)
    x, y = dense(rows, model)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, value = optimum(x, y, cost)
    assert value(w) <= value(model.weights[0]) <= value(w) * (1 + 1e-4)
    got = {r.doc_id: (r.margin, r.prediction) for r in model.transform(rows).collect()}
    want = dict(zip(sorted(got), x @ model.weights[0]))
    assert all(abs(got[i][0] - want[i]) < 1e-9 and got[i][1] == float(want[i] > 0) for i in got)


def test_problems_fitted_together_equal_those_fitted_alone(rows, monkeypatch):
    words = models.vocabulary(rows, least=2)
    targets = [2 * F.col("label") - 1, F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1)]
    costs = [F.lit(1.0), F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise(2.0)]
    both = margin.fit(rows, targets, costs, words, 0.5, 1e-7)
    monkeypatch.setattr(margin, "GROUPS", 1)  # sums by groups first
    for k in (0, 1):
        alone = margin.fit(rows, targets[k : k + 1], costs[k : k + 1], words, 0.5, 1e-7)
        assert np.abs(both.weights[k] - alone.weights[0]).max() < 1e-2


def test_a_saved_model_scores_alike(spark, rows, tmp_path):
    model = models.fit(rows, "svc")
    model.save(spark, str(tmp_path / "m"))
    again = margin.MarginModel.load(spark, str(tmp_path / "m"))
    assert sorted(model.transform(rows).select("doc_id", "margin").collect()) == sorted(again.transform(rows).select("doc_id", "margin").collect())
    assert again.terms == model.terms and again.idf == model.idf and (again.weights == model.weights).all()


def test_calibration_and_three_classes(spark, rows):
    got = models.calibrated(rows, rows).collect()
    assert len(got) == 153 and all(0 <= r.proba <= 1 for r in got)
    by_margin = sorted(got, key=lambda r: r.proba)
    assert by_margin[0].pred == 0 and by_margin[-1].pred == 1 and sum(r.pred == r.label for r in got) > 120
    three = models.three_class(rows.withColumn("label", (F.col("doc_id") % 3).cast("int")))
    assert {r["class"] for r in three.collect()} == {0, 1, 2} and sum(r.support for r in three.collect()) == 30  # 10 of 51 in each class


def test_first_of_a_text_keeps_one_whole_row(spark):
    rows = spark.createDataFrame([(3, "a", 1), (1, "a", 0), (None, "a", 1), (None, "b", 0), (5, None, 1), (4, "", 0), (1, "a", 0)], "doc_id long, text string, label int")
    assert sorted(map(str, models.first_of_text(rows).collect())) == ["Row(doc_id=1, text='a', label=0)", "Row(doc_id=4, text='', label=0)", "Row(doc_id=None, text='b', label=0)"]


@pytest.fixture(scope="module")
def encoded(rows):
    words = models.vocabulary(rows, least=2)
    names, idf = margin.merged([words, (words[0][::2], [2.0] * len(words[0][::2]))])
    assert set(names) == set(words[0]) and (idf[1] > 0).sum() == len(words[0][::2])
    return margin.blocks(rows, names, idf, [2 * F.col("label") - 1], [F.lit(1.0)]).persist(), idf


@pytest.mark.parametrize("head", [0, 7, 2_048])
def test_blocks_multiply_as_whole_matrices_do(encoded, monkeypatch, head):
    monkeypatch.setattr(margin, "HEAD", head)
    made, idf = encoded
    rng = np.random.default_rng(5)
    for batch in made.toArrow().to_batches():
        for i in range(batch.num_rows):
            block = margin._Block(batch, i, idf.shape[1])
            x = np.zeros((block.n, idf.shape[1]))
            row, at, values = (np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in ((1, np.int32), (2, np.int32), (3, float)))
            x[row, at] = values
            weights, slopes, sums = rng.normal(size=(3, idf.shape[1])), rng.normal(size=(block.n, 3)), np.ones((3, idf.shape[1]))
            block.add_to(sums, slopes)
            assert np.allclose(block.times(weights), x @ weights.T) and np.allclose(sums, 1 + slopes.T @ x)
            length = np.sqrt(((x[:, None] * idf) ** 2).sum(2))
            assert np.allclose(block.unit * length, length > 0)


def test_search_is_told_the_directions_that_reach_furthest(rows, encoded):
    """Without them a search took hundreds of passes on real texts, whose words in common reach thousands of times as far as others."""
    made, idf = encoded
    ways, squares, costs = margin.directions(made, idf, [margin.Problem(0, 0, 0, 1.0)], most=1_000)
    x = []
    for batch in made.toArrow().to_batches():
        for i in range(batch.num_rows):
            row, at, values, unit = (np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in ((1, np.int32), (2, np.int32), (3, float), (4, float)))
            some = np.zeros((batch.column(0)[i].as_py(), idf.shape[1] + 1))
            some[row, at] = values
            x.append(some * np.append(idf[0], 0) * unit.reshape(len(some), -1)[:, :1] + np.append(np.zeros(idf.shape[1]), 1))
    x = np.concatenate(x)
    assert costs == pytest.approx([1.0]) and np.allclose(np.sort(squares), np.linalg.eigvalsh(x.T @ x), atol=1e-8)
    assert np.allclose(((x @ ways.T) ** 2).sum(0), squares, atol=1e-8)


def test_sums_that_are_added_before_the_driver_are_the_same(encoded, monkeypatch):
    made, idf = encoded
    want = margin.class_sums(made, idf, [margin.Problem(0, 0, 1, 1.0)])
    monkeypatch.setattr(margin, "COLLECTED", 0)
    got = margin.class_sums(made, idf, [margin.Problem(0, 0, 1, 1.0)])
    assert (got[0] == want[0]).all() and np.allclose(got[1], want[1]) and want[0].sum() == 153
