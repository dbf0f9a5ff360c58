"""Descriptive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions.expr import half_up, month, percent
from revlake.functions.text import tokens


def profile(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count(F.lit(1)).alias("n_rows"), F.to_date(F.min("tanggal")).alias("first_day"), F.to_date(F.max("tanggal")).alias("last_day"), F.countDistinct(month("tanggal")).alias("n_months"), F.count_if(F.col("versi_app").isNull()).alias("missing_version"), F.count_if(F.col("sentimen_aktual").isNull()).alias("missing_label"))


def duplicates(texts: DataFrame) -> DataFrame:
    """Rows beyond the first of each text; null is a value."""
    by_text = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return by_text.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"), (F.sum("n") - F.count(F.lit(1))).alias("n_repeats"))


def rating_distribution(reviews: DataFrame) -> DataFrame:
    counts = reviews.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def length_by_label(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", F.size(tokens(F.coalesce("text", F.lit(""))))).groupBy("label").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("words")).alias("mean_words"), F.median("words").alias("median_words"), F.max("words").cast("long").alias("max_words"))


def short_texts(texts: DataFrame, short: int = 2, informative: int = 5) -> DataFrame:
    words = F.size(tokens(F.coalesce("text", F.lit(""))))
    return texts.select(words.alias("w")).agg(F.count_if(F.col("w") <= short).alias("n_short"), F.count_if(F.col("w") >= informative).alias("n_informative"), F.count(F.lit(1)).alias("n"))


def class_mix(reviews: DataFrame) -> DataFrame:
    """Shares of three classes and of the two labelled ones."""
    three = F.when(F.col("rating") <= 2, "negative").when(F.col("rating") == 3, "neutral").otherwise("positive")
    counts = reviews.groupBy(three.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    two = F.sum(F.when(F.col("class") != "neutral", F.col("n"))).over(everything)
    return counts.select("class", "n", percent(F.col("n"), F.sum("n").over(everything)).alias("share_of_three"), F.when(F.col("class") != "neutral", percent(F.col("n"), two)).alias("share_of_two"))


def version_coverage(reviews: DataFrame, thresholds: tuple[int, ...] = (30, 100, 200, 500)) -> DataFrame:
    counts = reviews.filter("versi_app is not null").groupBy("versi_app").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("n", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    enough = F.col("n") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(enough).alias("n_versions"), F.coalesce(F.sum(F.when(enough, F.col("n"))), F.lit(0)).alias("n_reviews"))


def likes_profile(reviews: DataFrame) -> DataFrame:
    quartiles = F.percentile("likes", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = reviews.agg(F.count("likes").alias("n"), half_up(F.avg("likes"), 4).alias("mean"), F.round(F.stddev_samp("likes"), 6).alias("std"), F.min("likes").alias("least"), quartiles.alias("q"), F.max("likes").alias("most"), percent(F.count_if(F.col("likes") == 0), F.count(F.lit(1))).alias("share_zero"))
    return out.select("n", "mean", "std", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "most", "share_zero")


def monthly_volume(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(month("tanggal").alias("bulan")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("rating").cast("decimal(38,10)"), 2).cast("double").alias("mean_rating"))


def top_texts(texts: DataFrame, limit: int = 20) -> DataFrame:
    return texts.filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "text").limit(limit)


def contract_report(reviews: DataFrame) -> DataFrame:
    """Violations by rule, in one pass; repeated ids by one more aggregation."""
    rules = reviews.agg(F.count_if(F.col("id").isNull()).alias("null_id"), F.count_if(~F.coalesce(F.col("rating").between(1, 5), F.lit(False))).alias("bad_rating"), F.count_if(F.coalesce(F.col("likes"), F.lit(-1)) < 0).alias("bad_likes"), F.count_if(F.col("tanggal").isNull()).alias("no_date"))
    repeated = reviews.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_id"))
    return rules.join(F.broadcast(repeated))  # one row


def check_contract(reviews: DataFrame) -> None:
    found = {k: v for k, v in contract_report(reviews).first().asDict().items() if v}
    if found:
        raise ValueError(f"contract violations: {found}")
