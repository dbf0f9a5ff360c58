from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from revlake.functions import text as T
from revlake.functions.expr import half_up, normal_upper, version_key
from revlake.operators import explore, lexicon, marts, release, serving, topics
from revlake.sources import adapters

REVIEWS = "id long, rating int, tanggal timestamp, likes long, versi_app string, versi_minor string, sentimen_aktual int"


def test_entry_and_register(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rounding_and_versions(spark):
    row = spark.range(1).select(half_up(F.lit(2.5), 0).alias("a"), F.bround(F.lit(2.5), 0).alias("b"), normal_upper(F.lit(-1.20004)).alias("p")).first()
    assert (row.a, row.b) == (3.0, 2.0) and abs(row.p - 0.884938) < 1e-6
    rows = spark.createDataFrame([("4.9",), ("4.10",), ("3.41",)], "v string")
    assert [r.v for r in rows.orderBy(version_key("v")).collect()] == ["3.41", "4.9", "4.10"]
    minor = spark.createDataFrame([("4.93.1",), (None,), ("abc",)], "v string").select(adapters.minor_version("v").alias("m")).collect()
    assert [r.m for r in minor] == ["4.93", None, None]


def test_partial_periods(spark):
    rows = [(1, 5, datetime(2021, 10, 1), 1, None, None, 1), (2, 1, datetime(2021, 11, 30, 23), 0, None, None, 0), (3, 3, datetime(2021, 12, 15), 0, None, None, None)]
    reviews = spark.createDataFrame(rows, REVIEWS)
    scores = spark.createDataFrame([(i, "final", i % 2) for i in (1, 2, 3)], "review_id long, model_name string, pred_label int")
    got = {r.bulan: r for r in marts.agg_monthly(reviews, scores).collect()}
    assert [got[d].periode_parsial for d in sorted(got)] == [False, False, True]
    weeks = sorted(marts.agg_weekly(reviews, scores).collect(), key=lambda r: r.bulan)
    assert [w.periode_parsial for w in weeks] == [True, False, True] and weeks[0].bulan == date(2021, 9, 27)
    trend = serving.trend(marts.agg_monthly(reviews, scores), date(2021, 10, 15), date(2021, 11, 2)).collect()
    assert [r.bulan for r in trend] == [date(2021, 10, 1), date(2021, 11, 1)]
    assert marts.agg_monthly(reviews.limit(0), scores).count() == 0


def test_bad_requests(spark):
    with pytest.raises(serving.BadRequest):
        serving.check_range(date(2022, 1, 2), date(2022, 1, 1))
    pairs = spark.createDataFrame([], "kategori_id long, review_id long, tanggal timestamp, rating int, likes long, pred_label int")
    for bad in ({"sort_by": "x"}, {"page": 0}, {"page_size": 0}):
        with pytest.raises(serving.BadRequest):
            serving.topic_reviews(pairs, 1, **({"sort_by": "likes", "page": 1, "page_size": 20} | bad))
    with pytest.raises(serving.BadRequest):
        serving.versions(pairs, 50)


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.04), ("d", None)], "v string, p double")
    got = {r.v: r.q for r in release.bh(rows, "p", "q").collect()}
    assert got["d"] is None and [round(got[k], 6) for k in "abc"] == [0.03, 0.04, 0.04]


def test_average_ranks_are_cut(spark):
    rows = spark.createDataFrame([("x", 5), ("y", 5), ("z", 1)], "k string, v long")
    assert {r.k: r.r for r in rows.select("k", topics.average_rank("v").alias("r")).collect()} == {"x": 1, "y": 1, "z": 3}


def test_text(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(T.clean_ascii(F.lit("Lihat https://a.b/c @dia #tag BAGUS!!  café 123"))) == "lihat bagus caf"
    assert one(T.clean_full(F.lit("jahatt mudahh bill sooooo"))) == "jahat mudah bill so"
    assert one(T.tokens(F.lit(""))) == [] and one(T.clean_ascii(F.lit(None).cast("string"))) == ""
    table = spark.createDataFrame([("gara", ["gara-gara"]), ("gabisa", ["tidak", "bisa"]), ("noise", [])], "token string, words array<string>")
    rows = spark.createDataFrame([(1, "gara gara gabisa x noise".split())], "id int, w array<string>")
    assert lexicon.folded(lexicon.attach(rows, "id", "w", table, "words", "e"), "w", "e", "out").first().out == ["gara-gara", "tidak", "bisa", "x"]
    assert one(T.bigrams(F.split(F.lit("a b c"), " "))) == ["a b", "b c"]
    flagged = T.language_counts(spark.createDataFrame([("the app is good and it works",), ("good",), (None,)], "text string")).collect()
    assert [r.is_english for r in flagged] == [True, False, False]


def test_contract(spark):
    good = [(1, 5, datetime(2021, 1, 1), 0, None, None, 1)]
    explore.check_contract(spark.createDataFrame(good, REVIEWS))
    with pytest.raises(ValueError, match="bad_rating"):
        explore.check_contract(spark.createDataFrame([*good, (1, 9, None, -1, None, None, 1)], REVIEWS))


def test_raw_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('﻿reviewId,userName,content,score,at,thumbsUpCount,reviewCreatedVersion\na,u,"two\nlines",5,2021-10-01 10:00:00,,4.93.1\nb,u,  ,1,2021-10-02 10:00:00,3,\nc,u,ok,x,bad,2,v1\n', encoding="utf-8")
    rows = adapters.ingest(adapters.read_raw(spark, str(path))).collect()
    assert [(r.review_key, r.ulasan, r.rating, r.likes, r.versi_minor) for r in rows] == [("a", "two\nlines", 5, 0, "4.93"), ("c", "ok", None, 2, None)]
    assert rows[0].tanggal == datetime(2021, 10, 1, 10) and rows[1].tanggal is None
    with pytest.raises(ValueError, match="columns are missing"):
        adapters.ingest(spark.createDataFrame([("x",)], "content string"))
