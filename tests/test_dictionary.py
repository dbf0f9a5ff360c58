from revlake.operators import dictionary, evaluation, models


def test_layers_and_discards(spark):
    one = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "word string, expansion string")
    two = spark.createDataFrame([("b", "w")], "word string, expansion string")
    got = dictionary.layered([one, two], spark.createDataFrame([("c",)], "word string"))
    assert sorted(map(tuple, got.collect())) == [("a", "x", 0), ("b", "w", 1)]


def test_number_check(spark):
    prose = spark.createDataFrame([(1, "akurasi 0,9261 dan 92,61 dari 526.322 ulasan"), (2, "salah 0,9999")], "line int, text string")
    facts = spark.createDataFrame([(0.9261,), (526322.0,)], "value double")
    assert [tuple(r) for r in dictionary.number_check(prose, facts).collect()] == [(2, "0,9999")]


def test_phrases_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "Bayar pembayaran!"), (2, "pembayaran"), (3, None)], "doc_id long, text string")
    assert {r.phrase: r.n_dokumen for r in dictionary.phrase_counts(texts, ("bayar", "pembayaran")).collect()} == {"bayar": 1, "pembayaran": 2}


def test_split_is_exact_by_class_and_dedup_is_for_training_only(spark):
    texts = spark.createDataFrame([(i, f"t{i % 40}", i % 2 if i < 90 else None) for i in range(100)], "doc_id long, text string, label int")
    train, test = models.split(texts)
    assert (train.count(), test.count()) == (72, 18) and train.join(test, "doc_id").count() == 0
    kept = models.first_of_text(train)
    assert kept.count() == train.select("text").distinct().count()
    weights = {r.label: r.weight for r in models.balanced(train).select("label", "weight").distinct().collect()}
    assert all(abs(w - 1) < 1e-9 for w in weights.values())


def test_one_class_predicted_scores_zero(spark):
    rows = spark.createDataFrame([("m", 0, 1), ("m", 1, 1)], "model_name string, label int, pred int")
    r = evaluation.metrics(rows).first()
    assert (r.accuracy, r.precision_neg, r.recall_neg, r.f1_neg) == (0.5, 0.0, 0.0, 0.0)
