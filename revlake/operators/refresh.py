"""Marts that readers never find half written, rebuilt whole or from new reviews only.

A store is a folder with tables that are never changed and numbered commits.  A commit is one small file that names, for every table, the
folders its rows lie in.  A refresh writes new folders and puts its commit in place last, by one rename that fails if another
refresh took the number; readers open the last commit, so they see the old marts or the new ones, whole.

All counts by month, week and version, and those of the whole, come from one table by day and version of additive
numbers; categories and keywords have such tables too.  New reviews are joined and summed by themselves and added to the last commit's
numbers, and their rows of the category pairs go into one more folder.  Beside the ids, which tell new reviews from known ones,
nothing of the old reviews is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlake.functions.expr import half_up, percent
from revlake.operators import marts

BASE = ("reviews", "scores", "topics", "review_topics")
STATES = ("by_day", "by_keyword", "by_category")
#: Tables of some hundred rows: one file each.
SMALL = ("agg_monthly", "agg_weekly", "agg_monthly_actual", "agg_version", "agg_topic_keyword", "agg_category", "agg_meta")


class Conflict(RuntimeError):
    """Another refresh was committed meanwhile."""


# Additive numbers


def by_day(reviews: DataFrame, scores: DataFrame, model: str = "final") -> DataFrame:
    """day, versi_minor -> numbers of reviews, scored ones, negative ones, labelled ones, and sums over the scored."""
    chosen = scores.filter(F.col("model_name") == model).select(F.col("review_id").alias("id"), "pred_label")
    rows = reviews.select("id", F.to_date("tanggal").alias("day"), "versi_minor", "rating", "likes", "sentimen_aktual").join(chosen, "id", "left")
    scored = F.col("pred_label").isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(scored, F.col(c).cast("long"))), F.lit(0))
    return rows.groupBy("day", "versi_minor").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(scored).alias("n_scored"), F.count_if(F.col("pred_label") == 0).alias("n_negative"), of("rating").alias("rating"), of("likes").alias("likes"),
        F.count("sentimen_aktual").alias("n_labelled"), F.count_if(F.col("sentimen_aktual") == 0).alias("n_negative_actual"),
    )


def by_keyword(review_topics: DataFrame, reviews: DataFrame) -> DataFrame:
    rows = review_topics.select("review_id", "topic_id").distinct().join(reviews.select(F.col("id").alias("review_id"), "likes", "rating"), "review_id")
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"), F.sum(F.col("rating").cast("long")).alias("rating"))


def by_category(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kategori_id", "kategori").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_label") == 0).alias("n_negative"), F.sum("likes").alias("likes"), F.sum(F.col("rating").cast("long")).alias("rating"))


_KEYS = {"by_day": ["day", "versi_minor"], "by_keyword": ["topic_id"], "by_category": ["kategori_id", "kategori"]}


def added(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    keys = _KEYS[name]
    return old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in old.columns if c not in keys))


# Marts from the numbers


def _periods(days: DataFrame, period, partial) -> DataFrame:
    bounds = F.broadcast(days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))  # one row
    measures = [F.sum("n_scored").alias("total_ulasan"), F.sum("n_negative").alias("jumlah_negatif"), percent(F.sum("n_negative"), F.sum("n_scored")).alias("persen_negatif"), half_up(F.sum("rating") / F.sum("n_scored")).alias("rata_rating"), F.sum("likes").alias("total_likes")]
    return days.filter("n_scored > 0").groupBy(period.alias("bulan")).agg(*measures).join(bounds).withColumn("periode_parsial", partial).drop("lo", "hi")


def built(states: dict[str, DataFrame], topics: DataFrame) -> dict[str, DataFrame]:
    """The small marts, equal to those of ``marts`` row for row."""
    days, words, categories = (states[n] for n in STATES)
    month, week = F.trunc("day", "MM"), F.to_date(F.date_trunc("WEEK", "day"))
    first, last = (F.to_date(F.date_trunc("WEEK", c)) for c in ("lo", "hi"))
    of_version = days.filter("versi_minor is not null and n_scored > 0").groupBy("versi_minor").agg(F.sum("n_scored").alias("total_ulasan"), F.sum("n_negative").alias("jumlah_negatif"), half_up(F.sum("rating") / F.sum("n_scored")).alias("rata_rating"), F.min("day").alias("pertama_muncul"))
    total, named = F.sum("n"), F.coalesce(F.sum(F.when(F.col("versi_minor").isNotNull(), F.col("n"))), F.lit(0))
    return {
        "agg_monthly": _periods(days, month, (F.trunc("lo", "MM") == F.col("bulan")) & (F.col("lo") > F.col("bulan")) | (F.trunc("hi", "MM") == F.col("bulan")) & (F.col("hi") < F.last_day("bulan"))),
        "agg_weekly": _periods(days, week, (F.col("bulan") == first) | (F.col("bulan") == last)),
        "agg_monthly_actual": days.groupBy(month.alias("bulan")).agg(F.sum("n_labelled").alias("n_berlabel"), F.sum("n_negative_actual").alias("n_negatif_aktual")),
        "agg_version": of_version.filter(F.col("total_ulasan") >= marts.MIN_REVIEWS).withColumn("persen_negatif", percent(F.col("jumlah_negatif"), F.col("total_ulasan"))),
        "agg_topic_keyword": words.withColumnRenamed("topic_id", "id").join(topics, "id").select("id", "kategori", "keyword", F.col("n").alias("jumlah_ulasan"), F.col("likes").alias("total_likes"), half_up(F.col("rating") / F.col("n")).alias("rata_rating")),
        "agg_category": categories.select(F.col("kategori_id").alias("id"), "kategori", F.col("n").alias("jumlah_ulasan"), F.col("n_negative").alias("jumlah_negatif"), percent(F.col("n_negative"), F.col("n")).alias("persen_negatif"), F.col("likes").alias("total_likes"), half_up(F.col("rating") / F.col("n")).alias("rata_rating")),
        "agg_meta": days.agg(F.coalesce(total, F.lit(0)).alias("total_ulasan"), named.alias("n_versi_minor_terisi"), percent(total - named, total).alias("versi_null_pct"), F.min("day").alias("tanggal_min"), F.max("day").alias("tanggal_max")),
    }


class Store:
    """A folder of immutable tables and numbered commits, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def last(self) -> int:
        """Number of the last commit, 0 before the first."""
        at = self._path(f"{self.folder}/commits")
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0

    def commit(self, number: int | None = None) -> dict[str, dict]:
        """Table -> {"folders": [...], "schema": ...} of a commit, of the last one if none is named."""
        number = self.last() if number is None else number
        if not number:
            return {}
        stream = self._fs.open(self._path(f"{self.folder}/commits/{number:010d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, commit: dict[str, dict] | None = None) -> DataFrame:
        entry = (self.commit() if commit is None else commit)[name]
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(*(f"{self.folder}/{x}" for x in entry["folders"]))

    def written(self, name: str, df: DataFrame) -> dict:
        at = f"tables/{name}-{uuid.uuid4().hex}"
        (df.coalesce(1) if name in SMALL else df).write.parquet(f"{self.folder}/{at}")
        return {"folders": [at], "schema": df.schema.jsonValue()}

    def put(self, after: int, tables: dict[str, dict]) -> int:
        """Makes ``tables`` the commit that follows ``after``; fails if there is one already."""
        number = after + 1
        draft, place = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.folder}/commits/{number:010d}")
        self._fs.mkdirs(place.getParent())
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()
        try:
            self._context.rename(draft, place, self._no_options)
        except Exception as e:
            if self._fs.exists(place):
                raise Conflict(f"commit {number} exists") from e
            raise
        return number

    def _marts(self, after: int, base: dict[str, dict], states: dict[str, DataFrame], topics: DataFrame, pairs: dict) -> int:
        tables = base | {"review_category": pairs} | {n: self.written(n, df) for n, df in states.items()}
        kept = {n: self.table(n, tables) for n in STATES}
        return self.put(after, tables | {n: self.written(n, df) for n, df in built(kept, topics).items()})

    def _pairs(self, topics: DataFrame, review_topics: DataFrame, reviews: DataFrame, scores: DataFrame) -> dict:
        """Category pairs in ranges of category, likes and review, so that a large category is many tasks and files."""
        pairs = marts.review_category(topics, review_topics, reviews, scores)
        return self.written("review_category", pairs.repartitionByRange("kategori_id", F.desc("likes"), "review_id").sortWithinPartitions("kategori_id", F.desc("likes"), "review_id"))

    def refresh(self, frames: dict[str, DataFrame]) -> int:
        """Loads the base tables and builds all marts; returns the commit."""
        after = self.last()
        base = {n: self.written(n, frames[n]) for n in BASE}
        reviews, scores, topics, links = (self.table(n, base) for n in BASE)
        pairs = self._pairs(topics, links, reviews, scores)
        states = {"by_day": by_day(reviews, scores), "by_keyword": by_keyword(links, reviews), "by_category": by_category(self.table("review_category", {"review_category": pairs}))}
        return self._marts(after, base, states, topics, pairs)

    def add(self, reviews: DataFrame, scores: DataFrame, review_topics: DataFrame) -> int:
        """Adds new reviews with their scores and topics; those whose id is known already are left as they are.  Returns the commit."""
        after = self.last()
        old = self.commit(after)
        topics = self.table("topics", old)
        new = self.written("reviews", reviews.dropDuplicates(["id"]).join(self.table("reviews", old).select("id"), "id", "left_anti").select(*self.table("reviews", old).columns))
        fresh = self.table("reviews", {"reviews": new})
        ids = fresh.select(F.col("id").alias("review_id"))
        base = {"reviews": new} | {n: self.written(n, df.join(ids, "review_id", "left_semi").select(*self.table(n, old).columns)) for n, df in (("scores", scores), ("review_topics", review_topics))}
        marks, links = self.table("scores", base), self.table("review_topics", base)
        pairs = self._pairs(topics, links, fresh, marks)
        fresh_states = {"by_day": by_day(fresh, marks), "by_keyword": by_keyword(links, fresh), "by_category": by_category(self.table("review_category", {"review_category": pairs}))}
        states = {n: added(n, self.table(n, old), df) for n, df in fresh_states.items()}
        joined = lambda n, entry: {"folders": old[n]["folders"] + entry["folders"], "schema": old[n]["schema"]}
        return self._marts(after, {n: joined(n, e) for n, e in base.items()} | {"topics": old["topics"]}, states, topics, joined("review_category", pairs))
