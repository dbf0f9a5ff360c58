"""The eight aggregate tables behind the dashboard: pure functions of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.functions.expr import half_up, month, percent, week

MIN_REVIEWS = 100


def scored(reviews: DataFrame, scores: DataFrame, model: str = "final") -> DataFrame:
    chosen = scores.filter(F.col("model_name") == model).select(F.col("review_id").alias("id"), "pred_label")
    return reviews.join(chosen, "id")


def _measures():
    negative = F.count_if(F.col("pred_label") == 0)
    return [F.count(F.lit(1)).alias("total_ulasan"), negative.alias("jumlah_negatif"), percent(negative, F.count(F.lit(1))).alias("persen_negatif"), half_up(F.avg("rating")).alias("rata_rating"), F.sum("likes").alias("total_likes")]


def _bounds(reviews: DataFrame) -> DataFrame:
    return F.broadcast(reviews.agg(F.to_date(F.min("tanggal")).alias("lo"), F.to_date(F.max("tanggal")).alias("hi")))  # one row


def agg_monthly(reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """Only a month that the data do not fill is partial."""
    grouped = scored(reviews, scores).groupBy(month("tanggal").alias("bulan")).agg(*_measures())
    partial = (F.trunc("lo", "MM") == F.col("bulan")) & (F.col("lo") > F.col("bulan")) | (F.trunc("hi", "MM") == F.col("bulan")) & (F.col("hi") < F.last_day("bulan"))
    return grouped.join(_bounds(reviews)).select(*grouped.columns, partial.alias("periode_parsial"))


def agg_weekly(reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """The first and the last week are partial, whatever they hold."""
    grouped = scored(reviews, scores).groupBy(week("tanggal").alias("bulan")).agg(*_measures())
    first, last = F.to_date(F.date_trunc("WEEK", "lo")), F.to_date(F.date_trunc("WEEK", "hi"))
    return grouped.join(_bounds(reviews)).select(*grouped.columns, ((F.col("bulan") == first) | (F.col("bulan") == last)).alias("periode_parsial"))


def agg_monthly_actual(reviews: DataFrame) -> DataFrame:
    label = F.col("sentimen_aktual")
    return reviews.groupBy(month("tanggal").alias("bulan")).agg(F.count_if(label.isNotNull()).alias("n_berlabel"), F.count_if(label == 0).alias("n_negatif_aktual"))


def agg_version(reviews: DataFrame, scores: DataFrame, least: int = MIN_REVIEWS) -> DataFrame:
    grouped = scored(reviews.filter("versi_minor is not null"), scores).groupBy("versi_minor")
    negative = F.count_if(F.col("pred_label") == 0)
    out = grouped.agg(F.count(F.lit(1)).alias("total_ulasan"), negative.alias("jumlah_negatif"), half_up(F.avg("rating")).alias("rata_rating"), F.to_date(F.min("tanggal")).alias("pertama_muncul"))
    return out.filter(F.col("total_ulasan") >= least).withColumn("persen_negatif", percent(F.col("jumlah_negatif"), F.col("total_ulasan")))


def agg_topic_keyword(topics: DataFrame, review_topics: DataFrame, reviews: DataFrame) -> DataFrame:
    joined = review_topics.join(reviews.select(F.col("id").alias("review_id"), "likes", "rating"), "review_id")
    grouped = joined.groupBy("topic_id").agg(F.countDistinct("review_id").alias("jumlah_ulasan"), F.sum("likes").alias("total_likes"), half_up(F.avg("rating")).alias("rata_rating"))
    return grouped.withColumnRenamed("topic_id", "id").join(topics, "id").select("id", "kategori", "keyword", "jumlah_ulasan", "total_likes", "rata_rating")


def review_category(topics: DataFrame, review_topics: DataFrame, reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per category and review; a category is named by its least topic id."""
    category = topics.groupBy("kategori").agg(F.min("id").alias("kategori_id"))
    named = topics.select(F.col("id").alias("topic_id"), "kategori").join(category, "kategori")
    pairs = review_topics.join(named, "topic_id").select("kategori_id", "kategori", F.col("review_id").alias("id")).distinct()
    return pairs.join(scored(reviews, scores).select("id", "tanggal", "rating", "likes", "pred_label"), "id").withColumnRenamed("id", "review_id")


def agg_category(pairs: DataFrame) -> DataFrame:
    negative = F.count_if(F.col("pred_label") == 0)
    return pairs.groupBy(F.col("kategori_id").alias("id"), "kategori").agg(F.count(F.lit(1)).alias("jumlah_ulasan"), negative.alias("jumlah_negatif"), percent(negative, F.count(F.lit(1))).alias("persen_negatif"), F.sum("likes").alias("total_likes"), half_up(F.avg("rating")).alias("rata_rating"))


def agg_meta(reviews: DataFrame) -> DataFrame:
    empty = F.count_if(F.col("versi_minor").isNull())
    return reviews.agg(F.count(F.lit(1)).alias("total_ulasan"), F.count("versi_minor").alias("n_versi_minor_terisi"), percent(empty, F.count(F.lit(1))).alias("versi_null_pct"), F.to_date(F.min("tanggal")).alias("tanggal_min"), F.to_date(F.max("tanggal")).alias("tanggal_max"))
