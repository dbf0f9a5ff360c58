"""The five feedback tables, derived from the order and part tables, and readers for raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("reviewId", "userName", "content", "score", "at", "thumbsUpCount", "reviewCreatedVersion")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rating = F.substring("o_orderpriority", 1, 1).cast("int")
    version = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("4."), F.floor(F.sqrt("o_custkey")).cast("string"), F.lit("."), (F.col("o_orderkey") % 3).cast("string")))
    rows = o.select(
        F.col("o_orderkey").alias("id"),
        rating.alias("rating"),
        F.col("o_orderdate").alias("tanggal"),
        F.greatest(F.lit(0), F.floor((F.col("o_totalprice") - 300000) / 1000)).cast("long").alias("likes"),
        version.alias("versi_app"),
        F.when(rating <= 2, 0).when(rating >= 4, 1).alias("sentimen_aktual"),
    )
    return rows.withColumn("versi_minor", minor_version("versi_app"))


def minor_version(column: str):
    """First two numbers of a version; null when there are none."""
    return F.nullif(F.regexp_extract(column, r"^(\d+\.\d+)", 1), F.lit(""))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of both models; the labels of ``final`` and ``alt``."""
    o = table(spark, sf_dir, "orders")
    both = F.array(
        F.struct(F.lit("final").alias("model_name"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("pred_label")),
        F.struct(F.lit("alt").alias("model_name"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("pred_label")),
    )
    return o.select(F.col("o_orderkey").alias("review_id"), F.inline(both))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (category, keyword), numbered in that order; as many rows as the dictionary has."""
    from pyspark.sql.window import Window

    pairs = table(spark, sf_dir, "part").select(F.col("p_type").alias("kategori"), F.col("p_brand").alias("keyword")).distinct()
    return pairs.withColumn("id", F.row_number().over(Window.orderBy("kategori", "keyword")).cast("long"))


def review_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kategori"), F.col("p_brand").alias("keyword"))
    return lines.join(parts, "l_partkey").join(topics(spark, sf_dir), ["kategori", "keyword"]).select(F.col("l_orderkey").alias("review_id"), F.col("id").alias("topic_id")).distinct()


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw feedback CSV: quoted line ends, an optional byte-order mark, all columns as text."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def ingest(raw: DataFrame) -> DataFrame:
    """Renames, drops empty texts, types the columns; unparsable values become null for the contract to count."""
    missing = {f.name for f in RAW} - set(raw.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return raw.filter(F.trim(F.coalesce("content", F.lit(""))) != "").select(
        F.col("reviewId").alias("review_key"),
        F.col("userName").alias("nama_user"),
        F.col("content").alias("ulasan"),
        F.expr("try_cast(score as int)").alias("rating"),
        F.expr("coalesce(try_to_timestamp(at, 'yyyy-MM-dd HH:mm:ss'), try_to_timestamp(at))").alias("tanggal"),
        F.coalesce(F.expr("try_cast(thumbsUpCount as int)"), F.lit(0)).alias("likes"),
        F.col("reviewCreatedVersion").alias("versi_app"),
        minor_version("reviewCreatedVersion").alias("versi_minor"),
    )
