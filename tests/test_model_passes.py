"""Models that share passes over the data are those that were fitted and applied one by one."""

import random

import pytest
from pyspark.sql import functions as F

from revlake.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["good", "fine", "nice"] if i % 2 else ["bad", "slow", "poor"], k=4) + rng.choices("abcdefgh", k=5)), i % 2) for i in range(60)]
    return models.terms(spark.createDataFrame(texts, "doc_id long, text string, label int")).persist()


def test_terms_of_all_folds_are_counted_once(rows):
    dealt = models.dealt(rows, [1 / 3, 2 / 3]).persist()
    for k, made in enumerate(models.fold_vocabularies(dealt, 3, most=25, least=2)):
        assert made == models.vocabulary(dealt.filter(F.col("part") != k), most=25, least=2)


def test_scores_in_one_pass_are_those_of_each_model(rows, monkeypatch):
    calls = []
    counted = models.vocabulary
    monkeypatch.setattr(models, "vocabulary", lambda *a: calls.append(1) or counted(*a))
    fitted = models.fit_all(rows, ("nb", "svc", "cnb"), min_df=2)
    assert len(calls) == 1 and list(fitted) == ["nb", "svc", "cnb"]
    got = models.score_all(fitted, rows)
    assert got.columns == ["doc_id", "label", "pred", "proba", "model_name"]
    for name, model in fitted.items():
        assert sorted(got.filter(F.col("model_name") == name).drop("model_name").collect()) == sorted(models.score(model, rows).collect())


def test_terms_are_counted_by_batch_before_they_move(spark):
    """One row for each term of a batch, not one for each occurrence."""
    rows = spark.createDataFrame([(["a", "b", "a"], 0), (["a"], 0), ([], 0), (None, 0), (["a", "c"], 1)], "terms array<string>, part int").coalesce(1)
    assert sorted(map(tuple, models._each_term(rows).collect())) == [("a", 4, 3), ("b", 1, 1), ("c", 1, 1)]
    assert sorted(map(tuple, models._each_term(rows, "part").collect())) == [(0, "a", 3, 2), (0, "b", 1, 1), (1, "a", 1, 1), (1, "c", 1, 1)]
