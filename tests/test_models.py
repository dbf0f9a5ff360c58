from revlake.operators import models
from revlake.operators.analysis import tfidf


def test_every_document_takes_part_in_every_pass_of_topics(spark):
    """Each pass adds the tokens of all documents to the topics; a draw of documents adds others."""
    texts = [[f"w{(i + j) % 40}" for j in range(1 + 3 * (i % 7 == 0) * i)] for i in range(80)]
    rows = spark.createDataFrame([(t,) for t in texts], "terms array<string>")
    vocabulary, model = models.fit_lda(rows, 3, 42)
    n = sum(w in set(vocabulary) for t in texts for w in t)
    assert n > 1000
    mass, cells = 3.0 * len(vocabulary), 3 * len(vocabulary)  # topics begin near 1, and eta is 1 / k
    for step in range(1, 11):
        rate = (1024 + step) ** -0.51
        mass = (1 - rate) * mass + rate * (n + cells / 3)
    assert abs(sum(model.topicsMatrix().toArray()) - mass) < 0.02 * mass


def test_only_document_frequency_limits_the_terms_of_topics(spark):
    texts = [" ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(i % 2, 11_000, 2)) for i in range(20)]
    texts += ["other"] * 5
    got = models.lda_topics(spark.createDataFrame([(t,) for t in texts], "text string"), k=2, top=20_000)
    assert got.select("term").distinct().count() == 11_000


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_split_cuts_each_label_at_exactly_the_share(spark):
    rows = [(i, f"t{i}", int(i < 6)) for i in range(106)] + [(500, "none", None), (None, "no id", 0), (None, "no id", 0)]
    got = [(r.label, r.part) for r in models.dealt(_texts(spark, rows), [0.8]).select("label", "part").collect()]
    assert {k: got.count(k) for k in set(got)} == {(1, 0): 5, (1, 1): 1, (0, 0): 82, (0, 1): 20}
    folds = models.dealt(_texts(spark, [(7, "same", 1)] * 50), [0.2, 0.4, 0.6, 0.8]).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in folds} == dict.fromkeys(range(5), 10)
    assert models.dealt(_texts(spark, []), [0.8]).count() == 0


def test_vectors_weigh_terms_as_the_table_of_weights_does(spark):
    rows = [(i, " ".join(f"w{chr(97 + (i * j) % 17)}" for j in range(1 + i % 9)), i % 2) for i in range(60)] + [(60, None, 1), (61, "", 0)]
    texts = models.terms(_texts(spark, rows))
    made = models.vectoriser(texts, most=40)
    words = made.stages[0].vocabulary
    assert len(words) == 40
    got = {(r.doc_id, words[i]): w for r in made.transform(texts).collect() for i, w in zip(r.features.indices, r.features.values)}
    cleaned = spark.createDataFrame([(r.doc_id, r.c) for r in texts.selectExpr("doc_id", "lower(regexp_replace(coalesce(text, ''), '[^a-z ]', '')) as c").collect()], "doc_id long, text string")
    want = {(r.doc_id, r.term): r.weight for r in tfidf(cleaned, most=40).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_measures_of_several_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, pred int")
    assert models.macro_f1(rows).first().macro_f1 == round((0.5 + 0.8 + 0) / 3, 6)
    assert {tuple(r) for r in models.class_metrics(rows).collect()} == {(0, 2, 0.5, 0.5, 0.5), (1, 2, 0.666667, 1.0, 0.8), (2, 1, 0.0, 0.0, 0.0)}


def test_a_saved_model_scores_alike_and_its_features_point_the_right_way(spark, tmp_path):
    rows = [(i, ("good fine" if i % 2 else "bad poor") + f" word{chr(97 + i % 5)}", i % 2) for i in range(60)]
    texts = models.terms(_texts(spark, rows))
    for kind in ("lr", "cnb", "nb"):
        model = models.fit(texts, kind)
        assert tuple(models.reload_check(model, texts, str(tmp_path / kind)).first()) == (60, 60)
        assert models.macro_f1(models.score(model, texts)).first().macro_f1 == 1.0
        ratios = {r.term: r.log_ratio for r in models.log_ratios(model, spark).collect()}
        assert ratios["good"] > 0 > ratios["bad"], kind


def test_error_sheet_keeps_what_people_wrote(spark):
    wrong = spark.createDataFrame([("m", i, 1, i % 2) for i in range(20)], "model_name string, doc_id long, label int, pred int")
    before = spark.createDataFrame([(i, "irony") for i in range(0, 20, 4)], "doc_id long, cause string")
    got = models.error_sheet(wrong, before, n=8).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 9))
    assert all(r.doc_id % 2 == 0 and r.cause == ("irony" if r.doc_id % 4 == 0 else None) for r in got)
