"""Counts and closed-form scores of predicted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_predictions(reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """model_name, label, pred of labelled reviews, with id and rating."""
    rows = reviews.filter("sentimen_aktual is not null").select("id", "rating", F.col("sentimen_aktual").alias("label"))
    return rows.join(scores.select(F.col("review_id").alias("id"), "model_name", F.col("pred_label").alias("pred")), "id")


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model_name", "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 of both classes with macro-F1; 0 where undefined."""
    hit = lambda l, p: F.count_if((F.col("label") == l) & (F.col("pred") == p)).cast("double")
    counts = predictions.groupBy("model_name").agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    f1_pos, f1_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return counts.select("model_name", (tp + tn + fp + fn).cast("long").alias("n_eval"), F.round(ratio(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"), F.round(ratio(tn, tn + fn), 6).alias("precision_neg"), F.round(ratio(tn, tn + fp), 6).alias("recall_neg"), F.round(f1_neg, 6).alias("f1_neg"), F.round((f1_pos + f1_neg) / 2, 6).alias("macro_f1"))


def majority_baseline(reviews: DataFrame) -> DataFrame:
    labels = reviews.filter("sentimen_aktual is not null").groupBy("sentimen_aktual").agg(F.count(F.lit(1)).alias("n"))
    return labels.agg(F.max_by("sentimen_aktual", F.struct("n", "sentimen_aktual")).alias("label"), F.round(F.max("n") / F.sum("n"), 6).alias("accuracy"))


def error_profile(predictions: DataFrame) -> DataFrame:
    wrong = predictions.filter("label <> pred")
    return wrong.groupBy("model_name", "rating", F.when(F.col("pred") == 0, "false_negative_sentiment").otherwise("false_positive_sentiment").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def model_overlap(predictions: DataFrame) -> DataFrame:
    """Jaccard of the error sets of each pair of models, by counts per row rather than a self-join."""
    by_row = predictions.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("label") != F.col("pred"), F.col("model_name")))).alias("wrong"))
    errors = by_row.select(F.explode("wrong").alias("a"), "wrong")
    own = errors.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    both = errors.select("a", F.explode("wrong").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    other = own.select(F.col("a").alias("b"), F.col("n").alias("nb"))
    return both.join(own, "a").join(other, "b").select("a", "b", "n_both", F.round(F.col("n_both") / (F.col("n") + F.col("nb") - F.col("n_both")), 6).alias("jaccard"))


def kappa(scores: DataFrame) -> DataFrame:
    """Cohen's kappa of the labels of the two models."""
    pair = scores.groupBy("review_id").agg(F.max(F.when(F.col("model_name") == "final", F.col("pred_label"))).alias("x"), F.max(F.when(F.col("model_name") == "alt", F.col("pred_label"))).alias("y"))
    t = pair.filter("x is not null and y is not null").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    po = F.col("same") / F.col("n")
    pe = (F.col("sx") * F.col("sy") + (F.col("n") - F.col("sx")) * (F.col("n") - F.col("sy"))) / (F.col("n") * F.col("n"))
    return t.select(F.col("n").cast("long").alias("n"), F.round(po, 6).alias("agreement"), F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))
