"""Dictionaries and corpus vocabulary: layering, candidates, collisions, phrase counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.functions.text import clean_ascii, tokens
from revlake.operators import facts


def layered(sources: list[DataFrame], discarded: DataFrame) -> DataFrame:
    """(word, expansion) frames by rising priority -> one expansion per word; discarded words go."""
    rows = None
    for priority, frame in enumerate(sources):
        part = frame.select("word", "expansion", F.lit(priority).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("word").agg(F.max(F.struct("priority", "expansion")).alias("x"))
    return best.join(discarded.select("word"), "word", "left_anti").select("word", F.col("x.expansion").alias("expansion"), F.col("x.priority").cast("long").alias("priority"))


def candidates(texts: DataFrame, known: DataFrame, least: int = 20, limit: int = 500) -> DataFrame:
    """Frequent tokens that no dictionary has, with the first document they stand in."""
    rows = texts.select("doc_id", F.explode(tokens(clean_ascii(F.col("text")))).alias("word")).filter(F.length("word") >= 2)
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("freq"), F.min("doc_id").alias("first_doc")).filter(F.col("freq") >= least)
    return counts.join(known.select("word"), "word", "left_anti").orderBy(F.desc("freq"), "word").limit(limit)


def collisions(topics: DataFrame) -> DataFrame:
    """Keywords of several categories, and the category that keeps each: that with the least name."""
    return topics.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_kategori"), F.min("kategori").alias("pemilik")).filter("n_kategori > 1")


def phrase_counts(texts: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """Documents with each phrase as whole words, in one pass."""
    padded = F.concat(F.lit(" "), clean_ascii(F.col("text")), F.lit(" "))
    row = texts.select(padded.alias("t")).agg(*(F.count_if(F.col("t").contains(f" {p} ")).alias(p) for p in phrases))
    pairs = F.array(*(F.struct(F.lit(p).alias("phrase"), F.col(f"`{p}`").alias("n_dokumen")) for p in phrases))
    return row.select(F.inline(pairs))


def word_counts(texts: DataFrame) -> DataFrame:
    """Words of the raw and of the cleaned text."""
    return texts.select("doc_id", F.size(tokens(F.coalesce("text", F.lit("")))).cast("long").alias("raw_words"), F.size(tokens(clean_ascii(F.col("text")))).cast("long").alias("clean_words"))


def number_check(lines: DataFrame, values: DataFrame) -> DataFrame:
    """line, written of numbers in lines of prose that equal no value, nor a hundred times one, at the decimals they are written with."""
    return facts.unexplained(lines, values.select("value", F.lit(None).cast("string").alias("words"), F.lit("ready").alias("status"))).select("line", "written")


def nb_counts(texts: DataFrame, least: int = 3) -> DataFrame:
    """Smoothed log ratio of each term between the two labels (multinomial, add one)."""
    rows = texts.filter("label is not null").select("label", F.explode(tokens(clean_ascii(F.col("text")))).alias("term"))
    counts = rows.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).filter(F.col("pos") + F.col("neg") >= least)
    totals = F.broadcast(counts.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.count(F.lit(1)).alias("v")))  # one row
    ratio = F.ln((F.col("pos") + 1) / (F.col("np") + F.col("v"))) - F.ln((F.col("neg") + 1) / (F.col("nn") + F.col("v")))
    return counts.join(totals).select("term", "pos", "neg", F.round(ratio, 6).alias("log_ratio"))
