import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from revlake.functions import normalise as N
from revlake.functions.expr import chi_square_upper, normal_upper
from revlake.operators import analysis as X
from revlake.operators import dictionary, lexicon, marts, release, serving, stemming, warehouse
from revlake.plans import more
from revlake.sources import adapters, files


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Kasi tau BINTANG 5 top up", "kasih tahu bintang lima topup"),
        ("mati2an kata2nya rp2.000 tahun2022", "mati matian kata katanya rp tahun"),
        ("jahatt mudahh bill baguuuus", "jahat mudah bill bagus"),
        ("b@ngsat was-was http://x.y/z @user 123", "bangsat waswas"),
        (None, ""),
    ],
)
def test_clean(spark, text, expected):
    assert one(spark, N.clean, text) == expected


def test_emoji_count_in_short_texts_only(spark):
    assert one(spark, N.clean_adaptive, "aplikasi memang 👍🏽👍💯") == "aplikasi memang bagus sempurna"
    assert one(spark, N.clean_adaptive, "🔥🔥🔥") == "keren"
    assert one(spark, N.clean_adaptive, "jangan mengemis ke konsumen 😭") == "jangan mengemis ke konsumen"


def test_a_single_text_goes_the_way_of_the_table(spark):
    row = (1, "n", "Pengemudinya tidak memuaskan, th lemot", 1, datetime(2024, 1, 1), 0, "5.11.2")
    raw = spark.createDataFrame([row], "id long, nama_user string, ulasan string, rating int, tanggal timestamp, likes int, versi_app string")
    slang = spark.createDataFrame([("th", ["tahun"])], "token string, words array<string>")
    stop = lexicon.stop_words(spark.createDataFrame([("tidak",)], "word string"), keep=())
    roots = spark.createDataFrame([("tahun",)], "root string")
    got = lexicon.clean_table(raw, slang, stop, lambda words: stemming.stem_words(words, roots)).first()
    assert (got.ulasan_normalized, got.ulasan_clean, got.versi_minor, got.word_count, got.sentimen_aktual) == ("pengemudinya tidak memuaskan tahun lemot", "pengemudi puas tahun lemot", "5.11", 5, 0)
    assert len(got) == 12


def test_sentences_are_translated_in_place(spark):
    docs = spark.createDataFrame([(1, "Good app. Bad driver!\nNice"), (2, "")], "doc_id long, text string")
    table = spark.createDataFrame([("Good app.", "Aplikasi bagus."), ("Nice", "Bagus")], "sentence string, translated string")
    assert [tuple(r) for r in N.translate_sentences(docs, table).collect()] == [(1, "Aplikasi bagus. Bad driver! Bagus")]


def test_marts_are_written_once_and_read_back(spark, tmp_path):
    sf, folder = "/root/testdata/sf0.001", str(tmp_path)
    base = {"reviews": adapters.reviews(spark, sf), "scores": adapters.scores(spark, sf), "topics": adapters.topics(spark, sf), "review_topics": adapters.review_topics(spark, sf)}
    assert warehouse.health(spark, folder)["status"] == "degraded"
    counts = warehouse.load_all(spark, base, folder)
    assert counts["scores"] == 2 * counts["reviews"]
    assert len(warehouse.refresh_all(spark, folder)) == 8 and warehouse.health(spark, folder) == {"status": "ok", "missing": []}
    read = lambda n: spark.read.parquet(f"{folder}/{n}")
    direct = serving.kpi(marts.agg_monthly(base["reviews"], base["scores"]), marts.agg_monthly_actual(base["reviews"]))
    assert serving.kpi(read("agg_monthly"), read("agg_monthly_actual")).first() == direct.first()
    warehouse.write_csv(read("agg_monthly").select("bulan", "persen_negatif"), f"{folder}/csv", {"persen_negatif": 1})
    assert re.fullmatch(r"\d+\.\d", spark.read.csv(f"{folder}/csv", header=True).first().persen_negatif)
    warehouse.write_document(spark, {"n": counts}, f"{folder}/doc")
    assert files.flatten_numbers({"n": counts, "x": [1, {"y": 2.5}], "z": True})[-2:] == [("x.0", 1.0), ("x.1.y", 2.5)]
    assert files.json_document(spark, f"{folder}/doc").first().n.reviews == counts["reviews"]
    assert len(files.content_hashes(spark, f"{folder}/doc").first().sha256) == 64
    assert files.lookup(spark, f"{folder}/none.csv", "a int") is None and files.lookup(spark, f"{folder}/csv", "bulan date, persen_negatif double").count() > 0


def test_upserts_repeat_without_effect_and_updates_must_be_complete(spark):
    old = spark.createDataFrame([("a_tuned", 1), ("b", 2)], "name string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "name string, v int")
    once = warehouse.upsert(old, new, ["name"])
    assert sorted(map(tuple, warehouse.upsert(once, new, ["name"]).collect())) == sorted(map(tuple, once.collect())) == [("a_tuned", 1), ("b", 3), ("c", 4)]
    texts = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    flagged = spark.createDataFrame([(2,)], "id int")
    update = lambda rows, mode="translate": [tuple(r) for r in warehouse.masked_update(texts, flagged, spark.createDataFrame(rows, "id int, t string"), "id", "t", mode).orderBy("id").collect()]
    assert update([(2, "z")]) == [(1, "x"), (2, "z")] and update([], "drop") == [(1, "x")] and update([], "off") == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="no replacement for 2"):
        update([])
    sheet = spark.createDataFrame([("good",), (" ",), ("odd",), (None,)], "label string")
    assert tuple(warehouse.check_sheet(sheet, "label", spark.createDataFrame([("good",)], "name string")).first()) == (2, 1)


def test_parameters(spark):
    for bad in ("", None, "x" * 1001, "  "):
        with pytest.raises(serving.BadRequest):
            warehouse.check_text(bad)
    with pytest.raises(warehouse.Missing):
        warehouse.required(spark.range(0), "rows")
    text = "a:\n  b: 3\n  c: 'x' # note\n  list:\n    - 1\n    - two\nd: [1, 2.5]\nflag: true\n"
    assert files.config(text) == {"a": {"b": 3, "c": "x", "list": [1, "two"]}, "d": [1, 2.5], "flag": True} and files.resolve(files.config(text), "a.b") == 3


def test_chi_square_tail():
    assert X.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert X.chi_square_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert X.chi_square_p(0, 3) == 1 and X.chi_square_p(8941.2, 197) < 1e-300


def test_numbers_that_no_fact_explains(spark):
    prose = spark.createDataFrame([*more._PROSE, (5, "1,234.5 dan 1.234,5")], "line int, text string")
    facts = spark.createDataFrame([(x,) for x in [*more._FACTS, 1234.5]], "value double")
    assert sorted(map(tuple, dictionary.number_check(prose, facts).collect())) == [(2, "0,91")]  # 1.234 is 1234.5 without decimals, as halves go to the even neighbour


def test_tails_as_columns(spark):
    cases = [(0.0, 3), (0.2, 1), (3.841458819694124, 1), (18.307038053275146, 10), (150.0, 197), (8941.2, 197), (5000.0, 5100), (None, 3), (2.0, None), (1e-9, 2)]
    rows = spark.createDataFrame(cases, "chi2 double, dof int").select("chi2", "dof", chi_square_upper(F.col("chi2"), F.col("dof")).alias("p")).collect()
    for r in rows:
        want = None if r.chi2 is None or r.dof is None else X.chi_square_p(r.chi2, r.dof)
        assert r.p == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-300))
    z = [-40.0, -3.2, -1e-8, 0.0, 0.3, 1.6448536269514722, 7.5, 30.0, None]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", normal_upper("z").alias("p")).collect():
        assert r.p == (None if r.z is None else pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-10))
    plan = spark.range(3).select(normal_upper(F.col("id").cast("double")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan  # tails stay in the JVM


def test_homogeneity_without_rows_and_with_one_version(spark):
    frame = lambda rows: spark.createDataFrame(rows, "versi_minor string, n long, neg long")
    assert tuple(release.chi_square(frame([])).first()) == (None, -1, None)
    assert tuple(release.chi_square(frame([("4.1", 200, 50)])).first()) == (0, 0, 1)
