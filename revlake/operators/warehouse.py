"""Tables: marts written once and read back, loads, upserts, checks, and the session's health."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.operators import marts
from revlake.operators.serving import BadRequest


class Missing(LookupError):
    """A result is empty where one is required."""


def write_parquet(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_csv(df: DataFrame, path: str, places: dict[str, int] | None = None) -> None:
    """A result table as one CSV with a header; ``places`` fixes the decimals of some columns."""
    shown = [F.format_string(f"%.{places[c]}f", F.col(c).cast("double")).alias(c) if places and c in places else F.col(c) for c in df.columns]
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # report tables: some hundred rows


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A provenance document as one line of JSON."""
    spark.createDataFrame([(json.dumps(document, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_all(spark: SparkSession, frames: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Truncates and loads base tables in the order given; returns their row counts, read back."""
    for name, df in frames.items():
        write_parquet(df, f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}").count() for name in frames}


def refresh_all(spark: SparkSession, folder: str) -> list[str]:
    """Rebuilds the eight marts from the base tables in ``folder``, each after those it reads; returns their names in that order."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    r, s, t, x = (read(n) for n in ("reviews", "scores", "topics", "review_topics"))
    order: dict[str, Callable[[], DataFrame]] = {
        "agg_monthly": lambda: marts.agg_monthly(r, s),
        "agg_weekly": lambda: marts.agg_weekly(r, s),
        "agg_monthly_actual": lambda: marts.agg_monthly_actual(r),
        "agg_version": lambda: marts.agg_version(r, s),
        "agg_topic_keyword": lambda: marts.agg_topic_keyword(t, x, r),
        "review_category": lambda: marts.review_category(t, x, r, s).repartitionByRange("kategori_id", F.desc("likes"), "review_id").sortWithinPartitions("kategori_id", F.desc("likes")),
        "agg_category": lambda: marts.agg_category(read("review_category")),
        "agg_meta": lambda: marts.agg_meta(r),
    }
    for name, build in order.items():
        write_parquet(build(), f"{folder}/{name}")
    return list(order)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``table`` that ``new`` has no key of, and all of ``new``; applied twice it changes nothing."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not processed yet."""
    return rows.join(done.select(*keys), keys, "left_anti")


def replace_suffix(table: DataFrame, new: DataFrame, column: str, suffix: str) -> DataFrame:
    """All rows whose name ends with the suffix are replaced by ``new``."""
    return table.filter(~F.col(column).endswith(suffix)).unionByName(new)


def masked_update(rows: DataFrame, flagged: DataFrame, new: DataFrame, key: str, column: str, mode: str = "translate") -> DataFrame:
    """``translate`` takes the text of flagged rows from ``new`` and fails if one is missing, ``drop`` drops them, ``off`` leaves all."""
    if mode == "off":
        return rows
    if mode == "drop":
        return rows.join(flagged.select(key), key, "left_anti")
    if mode != "translate":
        raise BadRequest("mode is translate, drop or off")
    marked = rows.join(flagged.select(key, F.lit(True).alias("__flag")), key, "left").join(new.select(key, F.col(column).alias("__new")), key, "left")
    missing = F.when(F.col("__flag") & F.col("__new").isNull(), F.raise_error(F.concat(F.lit("no replacement for "), F.col(key).cast("string"))))
    value = F.when(F.col("__flag"), F.coalesce("__new", missing.cast("string"))).otherwise(F.col(column))
    return marked.withColumn(column, value).select(*rows.columns)


def complete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side has and the other lacks, with the side; empty where a join would be complete."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("lacks", F.lit("right")).unionByName(b.join(a, keys, "left_anti").withColumn("lacks", F.lit("left")))


def check_sheet(sheet: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """One row: blank labels, and labels outside the taxonomy."""
    outside = sheet.filter(F.trim(F.coalesce(column, F.lit(""))) != "").join(allowed.select(F.col(allowed.columns[0]).alias(column)), column, "left_anti")
    return sheet.agg(F.count_if(F.trim(F.coalesce(column, F.lit(""))) == "").alias("n_blank")).join(F.broadcast(outside.agg(F.count(F.lit(1)).alias("n_outside"))))  # one row


def constraints(tables: dict[str, DataFrame], primary: dict[str, list[str]], foreign: list[tuple[str, str, str, str]]) -> DataFrame:
    """rule, violations: repeated or null primary keys, and foreign keys (table, column, other, column) that point nowhere."""
    out = None
    for name, keys in primary.items():
        some_null = F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 1
        counts = tables[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(some_null, F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("violations"))
        row = counts.select(F.lit(f"pk {name}").alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    for name, column, other, key in foreign:
        lost = tables[name].filter(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias(column)), column, "left_anti")
        row = lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"fk {name}.{column}").alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def required(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise Missing(what)
    return df


def check_text(text: str | None) -> str:
    """The text to predict: 1 to 1,000 characters, not blank."""
    if text is None or not 1 <= len(text) <= 1000:
        raise BadRequest("text has 1 to 1000 characters")
    if not text.strip():
        raise BadRequest("text is blank")
    return text


def health(spark: SparkSession, folder: str) -> dict:
    """ok, or degraded with the tables that cannot be read."""
    lost = []
    for name in ("reviews", "scores", "topics", "review_topics", "agg_monthly", "agg_version", "review_category", "agg_category", "agg_meta"):
        try:
            spark.read.parquet(f"{folder}/{name}").schema
        except Exception:  # whatever the reason, the table cannot be read
            lost.append(name)
    return {"status": "degraded" if lost else "ok", "missing": lost}
