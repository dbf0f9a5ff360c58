"""Keyword topics over category pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions.expr import half_up, month
from revlake.functions.text import bigrams, clean_ascii, tokens


def spread(texts: DataFrame) -> DataFrame:
    """Deals rows over the cores where the scan has fewer tasks than there are cores: cleaning costs more than moving them."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def average_rank(column: str):
    """Rank from the largest, ties at their mean, cut to an integer."""
    order, ties = Window.orderBy(F.desc(column)), Window.partitionBy(column)
    return F.floor(F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2).cast("long")


def category_rank(pairs: DataFrame) -> DataFrame:
    totals = pairs.groupBy("kategori").agg(F.count(F.lit(1)).alias("jumlah_ulasan"), F.sum("likes").alias("total_likes"), half_up(F.avg("likes")).alias("rata_likes"))
    ranked = totals.withColumns({"rank_freq": average_rank("jumlah_ulasan"), "rank_likes": average_rank("total_likes")})
    return ranked.withColumn("gap", F.col("rank_freq") - F.col("rank_likes"))


def category_trend(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(month("tanggal").alias("bulan"), "kategori").agg(F.count(F.lit(1)).alias("jumlah"))


def trigger_rows(topics: DataFrame, review_topics: DataFrame) -> DataFrame:
    """The one keyword per review and category that sorts first by score (its number of reviews), then name."""
    score = review_topics.groupBy("topic_id").agg(F.count(F.lit(1)).alias("score"))
    named = topics.select(F.col("id").alias("topic_id"), "kategori", "keyword").join(score, "topic_id")
    rows = review_topics.join(named, "topic_id").groupBy("review_id", "kategori").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "keyword")).alias("x"))
    return rows.select("review_id", "kategori", F.col("x.keyword").alias("keyword"), "score")


def story_examples(pairs: DataFrame, top: int = 3) -> DataFrame:
    """Most-liked reviews of each category, those in no other category first if there are enough of them."""
    marked = pairs.join(pairs.groupBy("review_id").agg((F.count(F.lit(1)) == 1).alias("alone")), "review_id")
    enough = marked.groupBy("kategori").agg((F.count_if("alone") >= top).alias("enough"))
    chosen = marked.join(enough, "kategori").filter("alone or not enough")
    order = Window.partitionBy("kategori").orderBy(F.desc("likes"), "review_id")
    return chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("kategori", F.col("rank").cast("long").alias("rank"), "review_id", "likes")


def ngram_top(texts: DataFrame, order: int = 1, limit: int = 30) -> DataFrame:
    """Most frequent n-grams of the cleaned text with term and document frequency."""
    words = tokens(clean_ascii(F.col("text")))
    grams = spread(texts).select("doc_id", words.alias("w")).select("doc_id", F.explode("w" if order == 1 else bigrams(F.col("w"))).alias("term"))
    per_doc = grams.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("n_dokumen")).orderBy(F.desc("freq"), "term").limit(limit)


def keyword_match(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Documents by keyword: distinct tokens and neighbouring pairs meet the keyword table."""
    words = texts.select("doc_id", tokens(clean_ascii(F.col("text"))).alias("w"))
    grams = words.select("doc_id", F.explode(F.array_distinct(F.concat("w", bigrams(F.col("w"))))).alias("keyword"))
    return grams.join(keywords, "keyword").select("doc_id", "kategori", "keyword")


def tfidf_weights(texts: DataFrame, least: int = 3) -> DataFrame:
    """Sublinear tf times smooth idf, one unit per document, of unigrams in enough documents."""
    counts = spread(texts).select("doc_id", F.explode(tokens(clean_ascii(F.col("text")))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    n = texts.agg(F.count(F.lit(1)).alias("n"))  # one row
    idf = df.join(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = counts.join(idf, "term").select("doc_id", "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, "doc_id").select("doc_id", "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))
