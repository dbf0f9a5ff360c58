import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from revlake.operators import analysis, finish, models
from revlake.plans import more, registry


@pytest.fixture(scope="module")
def parts(spark):
    words = ("good fine great nice", "bad poor slow broken")
    rows = [(i, f"{words[i % 2]} {'app login pay map'.split()[i % 4]}" * (1 + i % 3) if i % 11 else "ok", 1 - i % 2) for i in range(240)]
    train, test = models.split(models.terms(spark.createDataFrame(rows, "doc_id long, text string, label int")))
    return train.persist(), test.persist()


@pytest.mark.parametrize(("kind", "form"), [("nb", "pipeline"), ("lr", "parts"), ("svc", "pipeline")])
def test_every_form_is_read_back_alike(spark, parts, tmp_path, kind, form):
    folder = f"{tmp_path}/{kind}"
    made = finish.finish(*parts, folder, f"{kind}_final", kind, form=form)
    n = parts[1].count()
    assert tuple(finish.verify(spark, folder).first()) == (n, n)
    loaded = finish.load(spark, folder, f"{kind}_final")
    assert loaded.manifest == made and made["model"]["form"] == ("margin" if kind == "svc" else form)
    assert made["data"]["train"]["n"] == parts[0].count() and made["data"]["train_once"] == parts[0].select("text").distinct().count()


def test_measures_are_those_of_the_expected_rows(spark, parts, tmp_path):
    made = finish.finish(*parts, f"{tmp_path}/m", "m", "nb")
    rows = spark.read.parquet(f"{tmp_path}/m/expected").collect()
    for name, some in (("full", rows), ("informative_ge5w", [r for r in rows if len(r.text.split()) >= 5])):
        f1 = []
        for k in {r.label for r in some} | {r.pred for r in some}:
            tp, wrong = sum(r.label == r.pred == k for r in some), sum((r.label == k) != (r.pred == k) for r in some)
            f1.append(2 * tp / (2 * tp + wrong))
        assert made["measures"][name] == {"n": len(some), "accuracy": round(sum(r.label == r.pred for r in some) / len(some), 6), "macro_f1": round(sum(f1) / len(f1), 6)}


def test_a_new_process_scores_alike_and_tells_a_change(spark, parts, tmp_path):
    folder = f"{tmp_path}/new"
    finish.finish(*parts, folder, "final", "nb")
    run = lambda: subprocess.run([sys.executable, "-m", "revlake.operators.finish", folder], cwd=Path(finish.__file__).parents[2], capture_output=True, text=True, timeout=300)
    done = run()
    assert done.returncode == 0 and "rows alike" in done.stdout, done.stderr
    rows = spark.read.parquet(f"{folder}/expected").collect()
    changed = [(r.doc_id, r.label, 1 - r.pred if i == 0 else r.pred, r.proba, r.text) for i, r in enumerate(rows)]
    spark.createDataFrame(changed, "doc_id long, label int, pred int, proba double, text string").write.mode("overwrite").parquet(f"{folder}/expected")
    assert run().returncode == 1


def test_names_must_agree(spark, parts, tmp_path):
    made = finish.finish(*parts, f"{tmp_path}/g", "final", "nb")
    with pytest.raises(finish.WrongModel):
        finish.load(spark, f"{tmp_path}/g", "other")
    scores = spark.createDataFrame([(1, "final"), (2, "alt")], "review_id long, model_name string")
    finish.same_model(made, scores)
    for bad in (scores.filter("model_name = 'alt'"), scores.limit(0)):
        with pytest.raises(finish.WrongModel):
            finish.same_model(made, bad)


def test_unfinished_folders_are_refused(spark, parts, tmp_path):
    with pytest.raises(finish.Broken):
        finish.load(spark, f"{tmp_path}/none")
    finish.warehouse.write_document(spark, {"status": "writing"}, f"{tmp_path}/half/manifest")
    with pytest.raises(finish.Broken):
        finish.load(spark, f"{tmp_path}/half")
    with pytest.raises(ValueError):
        finish.finish(*parts, f"{tmp_path}/x", "x", "nb", form="zip")


def test_fingerprint_heeds_rows_and_not_their_order(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "a long, b string")
    one = finish.fingerprint(frame((1, "x"), (2, None), (2, None)), "a", "b")
    assert one == finish.fingerprint(frame((2, None), (1, "x"), (2, None)).repartition(3), "a", "b") and one["n"] == 3
    assert one["digest"] not in {finish.fingerprint(frame(*x), "a", "b")["digest"] for x in ([(1, "x"), (2, None)], [(1, "x"), (2, None), (2, "")], [(1, "x"), (1, "x"), (2, None)])}
    assert finish.fingerprint(spark.createDataFrame([], "a long, b string"), "a", "b")["n"] == 0


def test_grid_feeds_the_choice(spark, parts):
    grid = models.cv_grid(models.first_of_text(parts[0]), {"nb": [0.1, 2.0], "svc": [(0.1, False), (1.0, True)]}, folds=2, min_df=1)
    rows = {(r.model_name, r.setting, r.balanced): r for r in grid.collect()}
    assert set(rows) == {("nb", 0.1, True), ("nb", 2.0, True), ("svc", 0.1, False), ("svc", 1.0, True)}
    assert rows["nb", 2.0, True].complexity == -2 and rows["svc", 1.0, True].complexity == 1
    assert all(abs(r.gap - round(r.train_score - r.mean_score, 6)) < 1e-9 for r in rows.values())
    for r in analysis.one_se_choice(grid).collect():
        mine = [x for x in rows.values() if x.model_name == r.model_name]
        top = max(mine, key=lambda x: x.mean_score)
        within = [x for x in mine if x.mean_score >= top.mean_score - top.std_score]
        assert (r.n_within, r.complexity) == (len(within), min(x.complexity for x in within))


def test_grid_scores_are_those_of_models_fitted_by_hand(spark, parts):
    train = models.first_of_text(parts[0]).persist()
    row = models.cv_grid(train, {"nb": [0.5]}, folds=3, min_df=1).first()
    f1 = []
    dealt = models.dealt(train, [1 / 3, 2 / 3]).persist()
    for fold in range(3):
        scored = models.score(models.fit(dealt.filter(F.col("part") != fold), "nb", min_df=1, setting=0.5), dealt.filter(F.col("part") == fold)).collect()
        per = []
        for k in {r.label for r in scored} | {r.pred for r in scored}:
            tp, wrong = sum(r.label == r.pred == k for r in scored), sum((r.label == k) != (r.pred == k) for r in scored)
            per.append(2 * tp / (2 * tp + wrong))
        f1.append(sum(per) / len(per))
    mean = sum(f1) / 3
    assert row.mean_score == pytest.approx(mean, abs=2e-6)
    assert row.std_score == pytest.approx((sum((x - mean) ** 2 for x in f1) / 3) ** 0.5, abs=2e-6)


def test_grid_models_of_all_kinds_are_those_of_spark(spark, parts):
    train = models.first_of_text(parts[0]).persist()
    got = {(r.model_name, r.setting): r for r in models.cv_grid(train, {"nb": [0.1], "cnb": [0.1, 2.0], "lr": [0.5]}, folds=2, min_df=1).collect()}
    dealt = models.dealt(train, [0.5]).persist()
    for (kind, setting), row in got.items():
        held, own = [], []
        for fold in (0, 1):
            rows = dealt.filter(F.col("part") != fold)
            model = models.fit(rows, kind, min_df=1, setting=setting)
            held.append(models.macro_f1(models.score(model, dealt.filter(F.col("part") == fold))).first().macro_f1)
            own.append(models.macro_f1(models.score(model, rows)).first().macro_f1)
        assert (row.mean_score, row.train_score) == pytest.approx((sum(held) / 2, sum(own) / 2), abs=2e-6), (kind, setting)


def test_query_grid_has_all_settings(monkeypatch):
    """The query leaves no kind, setting or balance of costs out: 24 in all."""
    seen = []
    monkeypatch.setattr(models, "cv_grid", lambda train, grid=models.GRID: seen.append(grid))
    monkeypatch.setattr(registry, "_parts", lambda f: (None, None))
    registry.QUERIES["cv_grid"][0](None)
    more._grid(None)
    assert seen == [models.GRID, models.GRID] and sum(map(len, models.GRID.values())) == 24
