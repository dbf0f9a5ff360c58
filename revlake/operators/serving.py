"""The parameterised queries a dashboard asks, over the aggregate tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.functions.expr import half_up, percent
from revlake.operators.marts import MIN_REVIEWS, agg_category


class BadRequest(ValueError):
    """A parameter is out of its bounds."""


def check_range(start: date | None, end: date | None) -> None:
    if start and end and start > end:
        raise BadRequest("from is after to")


def in_periods(df: DataFrame, start: date | None, end: date | None, unit: str) -> DataFrame:
    """Rows of whole periods: the bounds are widened to the periods they fall in."""
    check_range(start, end)
    if start:
        df = df.filter(F.col("bulan") >= F.to_date(F.date_trunc(unit, F.lit(start))))
    if end:
        df = df.filter(F.col("bulan") <= F.to_date(F.date_trunc(unit, F.lit(end))))
    return df


def on_days(df: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Rows from the start of the first day to the end of the last."""
    check_range(start, end)
    if start:
        df = df.filter(F.col("tanggal") >= F.lit(start))
    if end:
        df = df.filter(F.col("tanggal") < F.date_add(F.lit(end), 1))
    return df


def kpi(monthly: DataFrame, actual: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """One row; the mean rating weighs the months' rounded means."""
    months = in_periods(monthly.join(actual, "bulan"), start, end, "MONTH")
    weighted = F.sum((F.col("rata_rating") * F.col("total_ulasan")).cast("decimal(20,2)")) / F.nullif(F.sum("total_ulasan"), F.lit(0))
    partial = F.sort_array(F.collect_list(F.when(F.col("periode_parsial"), F.date_format("bulan", "yyyy-MM"))))
    return months.agg(F.sum("total_ulasan").alias("total_ulasan"), percent(F.sum("jumlah_negatif"), F.sum("total_ulasan")).alias("persen_negatif_model"), percent(F.sum("n_negatif_aktual"), F.sum("n_berlabel")).alias("persen_negatif_aktual"), half_up(weighted).alias("rata_rating"), F.array_join(partial, ",").alias("bulan_parsial"))


def trend(periods: DataFrame, start: date | None, end: date | None, granularity: str = "month") -> DataFrame:
    if granularity not in ("month", "week"):
        raise BadRequest("granularity is month or week")
    return in_periods(periods, start, end, granularity.upper()).orderBy("bulan")


def versions(by_version: DataFrame, least: int = MIN_REVIEWS) -> DataFrame:
    if least < MIN_REVIEWS:
        raise BadRequest(f"min_reviews is {MIN_REVIEWS} at least")
    return by_version.filter(F.col("total_ulasan") >= least).orderBy("pertama_muncul", "versi_minor")


def top_topics(by_category: DataFrame, limit: int) -> DataFrame:
    return by_category.orderBy(F.desc("jumlah_ulasan"), "id").limit(limit)


def topics_in(pairs: DataFrame, limit: int, start: date | None, end: date | None) -> DataFrame:
    return top_topics(agg_category(on_days(pairs, start, end)), limit)


def topic_coverage(pairs: DataFrame, start: date | None, end: date | None) -> DataFrame:
    return on_days(pairs, start, end).agg(F.countDistinct("kategori_id").alias("n_kategori"), F.countDistinct("review_id").alias("ulasan_unik"))




def topic_reviews(pairs: DataFrame, category_id: int, sort_by: str, page: int, page_size: int) -> DataFrame:
    """One page; total_halaman is 1 at least."""
    if page < 1 or not 1 <= page_size <= 100:
        raise BadRequest("page from 1, page_size 1 to 100")
    order = {"likes": [F.desc("likes"), F.col("review_id")], "tanggal": [F.desc("tanggal"), F.col("review_id")], "rating": [F.col("rating"), F.desc("likes"), F.col("review_id")]}.get(sort_by)
    if order is None:
        raise BadRequest("sort_by is likes, tanggal or rating")
    rows = pairs.filter(F.col("kategori_id") == category_id)
    total = F.broadcast(rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / page_size)).cast("long").alias("total_halaman")))  # one row
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size).join(total).select("review_id", "tanggal", "rating", "likes", "pred_label", "total_halaman")
