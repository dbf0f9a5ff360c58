"""The dashboard's reads over written marts: each opens only the table it needs."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.operators import analysis, serving
from revlake.operators.refresh import Store


class Dashboard:
    """Reads over one commit of a store, or over the folder that ``warehouse.load_all`` and ``refresh_all`` wrote.

    All reads of one dashboard see the same commit, whatever is committed meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.store = spark, folder, Store(spark, folder)
        self.commit = self.store.commit()

    def table(self, name: str) -> DataFrame:
        return self.store.table(name, self.commit) if self.commit else self.spark.read.parquet(f"{self.folder}/{name}")

    monthly = cached_property(lambda self: self.table("agg_monthly"))
    weekly = cached_property(lambda self: self.table("agg_weekly"))
    actual = cached_property(lambda self: self.table("agg_monthly_actual"))
    by_version = cached_property(lambda self: self.table("agg_version"))
    pairs = cached_property(lambda self: self.table("review_category"))
    by_category = cached_property(lambda self: self.table("agg_category"))
    meta = cached_property(lambda self: self.table("agg_meta"))

    def kpi(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return analysis.kpi_full(serving.kpi(self.monthly, self.actual, start, end), self.by_version, self.meta)

    def trend(self, start: date | None = None, end: date | None = None, granularity: str = "month") -> DataFrame:
        return serving.trend(self.weekly if granularity == "week" else self.monthly, start, end, granularity)

    def versions(self, least: int = 100) -> DataFrame:
        return serving.versions(self.by_version, least)

    def topics(self, limit: int, start: date | None = None, end: date | None = None) -> DataFrame:
        return serving.topics_in(self.pairs, limit, start, end) if start or end else serving.top_topics(self.by_category, limit)

    def coverage(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return serving.topic_coverage(self.pairs, start, end)

    def reviews(self, category_id: int, sort_by: str, page: int, page_size: int = 20) -> DataFrame:
        """One page of a category; the page is cut first, and only its rows meet the table of reviews."""
        rows = serving.topic_reviews(self.pairs, category_id, sort_by, page, page_size)
        extra = self.table("reviews").select(F.col("id").alias("review_id"), "versi_app", "sentimen_aktual")
        return extra.join(F.broadcast(rows), "review_id")  # page_size rows
