"""Second-level tables: agreement, intervals, keyword selection, coherence, choices among models, release follow-up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions.expr import half_up, month, percent
from revlake.functions.text import bigrams, clean_ascii, tokens
from revlake.operators import release


# descriptive remainder


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, n_missing, share: one pass over the table."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns))
    return row.select("__n", F.inline(pairs)).select("column", "n_missing", percent(F.col("n_missing"), F.col("__n")).alias("share"))


def duplicate_scopes(texts: DataFrame) -> DataFrame:
    """Rows beyond the first: by full row, by text, by text within label.  Null is a value."""
    cols = {"row": [c for c in texts.columns], "text": ["text"], "text_in_label": ["text", "label"]}
    one = lambda name, keys: texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg((F.sum("n") - F.count(F.lit(1))).alias("n_repeats")).select(F.lit(name).alias("scope"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"))
    parts = [one(name, keys) for name, keys in cols.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rating_pivot(reviews: DataFrame) -> DataFrame:
    """Months by rating 1 to 5, missing cells 0."""
    wide = reviews.groupBy(month("tanggal").alias("bulan")).pivot("rating", [1, 2, 3, 4, 5]).agg(F.count(F.lit(1)))
    return wide.select("bulan", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"rating_{k}") for k in range(1, 6)))


def extreme_months(monthly: DataFrame) -> DataFrame:
    """Months of the greatest and the least negative share; of equal ones the earlier."""
    late = F.datediff(F.lit("2100-01-01").cast("date"), "bulan")
    return monthly.agg(F.max_by("bulan", F.struct("persen_negatif", late)).alias("worst"), F.max("persen_negatif").alias("worst_pct"), F.min_by("bulan", F.struct("persen_negatif", "bulan")).alias("best"), F.min("persen_negatif").alias("best_pct"))


def series_agreement(monthly: DataFrame, actual: DataFrame) -> DataFrame:
    """Pearson correlation and mean absolute difference of the model's and the labels' monthly negative shares."""
    both = monthly.join(actual, "bulan").withColumn("actual_pct", percent(F.col("n_negatif_aktual"), F.col("n_berlabel")))
    gap = F.abs(F.col("persen_negatif") - F.col("actual_pct"))
    return both.agg(F.count(F.lit(1)).alias("n_months"), F.round(F.corr("persen_negatif", "actual_pct"), 6).alias("pearson"), F.round(F.avg(gap), 6).alias("mean_abs_diff"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """Distinct tokens by their first letter."""
    words = texts.select(F.explode(tokens(clean_ascii(F.col("text")))).alias("w")).distinct()
    return words.groupBy(F.substring("w", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n_tokens"))


def categories_per_review(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """How many reviews have how many categories, 0 included, with their share."""
    per = pairs.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_kategori"))
    counts = per.groupBy("n_kategori").agg(F.count(F.lit(1)).alias("n"))
    none = reviews.select(F.col("id").alias("review_id")).join(per, "review_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("n_kategori"), "n")
    return counts.unionByName(none).withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def length_band(texts: DataFrame, low: int = 40, high: int = 300) -> DataFrame:
    n = F.length("text")
    return texts.filter(n.between(low, high)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(n).cast("long").alias("n_chars"))


def typical(texts: DataFrame, low: int = 10, high: int = 60) -> DataFrame:
    """Texts of typical length by source."""
    return texts.withColumn("w", F.size(tokens(F.coalesce("text", F.lit(""))))).filter(F.col("w").between(low, high)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("words"))


# evaluation


def dual_sets(predictions: DataFrame) -> DataFrame:
    """Rows of both evaluation sets: ``full``, and ``informative_ge5w`` with five words or more."""
    named = F.when(F.col("words") >= 5, F.array(F.lit("full"), F.lit("informative_ge5w"))).otherwise(F.array(F.lit("full")))
    return predictions.withColumn("eval_set", F.explode(named))


def dual_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and macro-F1 by model and evaluation set, the majority baseline first in each set."""
    hit = lambda l, p: F.count_if((F.col("label") == l) & (F.col("pred") == p)).cast("double")
    rows = dual_sets(predictions).groupBy("eval_set", "model_name").agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    macro = (ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fp + fn)) / 2
    out = rows.select("eval_set", "model_name", (tp + tn + fp + fn).cast("long").alias("n_eval"), F.round(ratio(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"), F.round(macro, 6).alias("macro_f1"))
    return out.orderBy("eval_set", (F.col("model_name") == "majority_baseline").desc(), F.desc("macro_f1"), "model_name")


def word_bucket(words: Column) -> Column:
    return F.when(words <= 2, "0-2").when(words <= 4, "3-4").when(words < 20, "5-19").otherwise("20+")


def error_rates(predictions: DataFrame) -> DataFrame:
    """Errors by model, word bucket and direction, and errors in each bucket as a share of its rows."""
    rows = predictions.withColumn("bucket", word_bucket(F.col("words")))
    out = rows.groupBy("model_name", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("label") == 1) & (F.col("pred") == 0)).alias("false_negative"), F.count_if((F.col("label") == 0) & (F.col("pred") == 1)).alias("false_positive"))
    return out.withColumn("error_pct", percent(F.col("false_negative") + F.col("false_positive"), F.col("n")))


def wilson(rows: DataFrame, hits: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """Adds the Wilson interval of a proportion, in per cent."""
    p, m = F.col(hits) / F.col(n), F.col(n).cast("double")
    middle, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return rows.withColumns({"low": F.round(100 * (middle - spread) / (1 + z * z / m), 6), "high": F.round(100 * (middle + spread) / (1 + z * z / m), 6)})


def noise_ceiling(predictions: DataFrame, sampled: Column, noisy: Column) -> DataFrame:
    """What accuracy could be at most if the share of noisy labels among sampled errors held for all errors."""
    wrong = F.col("label") != F.col("pred")
    row = predictions.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_errors"), F.count_if(wrong & sampled).alias("n_sampled"), F.count_if(wrong & sampled & noisy).alias("n_noisy"))
    share = F.col("n_noisy") / F.nullif(F.col("n_sampled"), F.lit(0))
    return row.withColumns({"noise_pct": F.round(100 * share, 6), "ceiling_pct": F.round(100 * (1 - F.col("n_errors") * (1 - share) / F.col("n")), 6)})


def set_agreement(pairs: DataFrame) -> DataFrame:
    """(id, main, other array) against (id, main, other): loose, strict agreement, mean Jaccard and kappa of the main labels."""
    inter, union = F.size(F.array_intersect("set_a", "set_b")), F.size(F.array_union("set_a", "set_b"))
    rows = pairs.withColumns({"loose": F.array_contains("set_b", F.col("main_a")), "strict": F.col("main_a") == F.col("main_b"), "j": F.when(union > 0, inter / union).otherwise(0.0)})
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("loose").cast("double")).alias("loose"), F.avg(F.col("strict").cast("double")).alias("strict"), F.avg("j").alias("jaccard"))
    a = rows.groupBy(F.col("main_a").alias("m")).agg(F.count(F.lit(1)).alias("na"))
    b = rows.groupBy(F.col("main_b").alias("m")).agg(F.count(F.lit(1)).alias("nb"))
    chance = a.join(b, "m").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("both"))
    pe = F.col("both") / (F.col("n").cast("double") * F.col("n"))
    return total.join(F.broadcast(chance)).select("n", F.round("loose", 6).alias("loose"), F.round("strict", 6).alias("strict"), F.round("jaccard", 6).alias("jaccard"), F.round((F.col("strict") - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))  # one row


def one_se_choice(cv: DataFrame) -> DataFrame:
    """Of each model's settings within one standard deviation of its best score, the simplest (least ``complexity``, then best score).

    The columns ``setting`` and ``balanced`` are kept where there are any.
    """
    extra = [c for c in ("setting", "balanced") if c in cv.columns]
    best = Window.partitionBy("model_name").orderBy(F.desc("mean_score"), "complexity", *extra)
    rows = cv.withColumns({"bar": F.first(F.col("mean_score") - F.col("std_score")).over(best), "top": F.first("mean_score").over(best)}).filter("mean_score >= bar")
    within = Window.partitionBy("model_name")
    order = within.orderBy("complexity", F.desc("mean_score"), *extra)
    rows = rows.withColumns({"n_within": F.count(F.lit(1)).over(within), "r": F.row_number().over(order)}).filter("r = 1")
    return rows.select("model_name", "complexity", "mean_score", F.round("bar", 6).alias("bar"), "n_within", (F.col("mean_score") == F.col("top")).alias("same_as_best"), *extra)


# topics


def topic_terms(texts: DataFrame, topic: str, order: int = 1) -> DataFrame:
    """topic, term, tf, df: term and document counts of the documents of each topic."""
    words = tokens(clean_ascii(F.col("text")))
    rows = texts.select("doc_id", F.col(topic).alias("topic"), words.alias("w")).select("doc_id", "topic", F.explode("w" if order == 1 else bigrams(F.col("w"))).alias("term"))
    per_doc = rows.groupBy("doc_id", "topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("topic", "term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def keyword_lift(terms: DataFrame, n_docs: DataFrame, least_df: int = 10, weight: float = 0.6) -> DataFrame:
    """Adds p(term | topic), lift, document share, concentration and relevance to ``topic_terms`` rows of terms in enough documents."""
    by_term, by_topic = Window.partitionBy("term"), Window.partitionBy("topic")
    rows = terms.withColumns({"df_all": F.sum("df").over(by_term), "tf_all": F.sum("tf").over(by_term)})
    topics = terms.groupBy("topic").agg(F.sum("tf").alias("n_topic"))
    topics = topics.withColumn("n_all", F.sum("n_topic").over(Window.partitionBy()))  # one row per topic
    rows = rows.filter(F.col("df_all") >= least_df).join(F.broadcast(topics), "topic").join(F.broadcast(n_docs))  # rows per topic; one row
    p, base = F.col("tf") / F.col("n_topic"), F.col("tf_all") / F.col("n_all")
    return rows.select(
        "topic", "term", "tf", "df",
        F.round(p, 9).alias("phi"),
        F.round(p / base, 6).alias("lift"),
        F.round(100.0 * F.col("df_all") / F.col("n_docs"), 6).alias("df_pct"),
        F.round(F.col("tf") / F.col("tf_all"), 6).alias("concentration"),
        F.round(weight * F.ln(p) + (1 - weight) * F.ln(p / base), 6).alias("relevance"),
    )


def keywords(lifted: DataFrame, most_df: float = 15.0, least_lift: float = 2.0, top: int = 10) -> DataFrame:
    """The first ``top`` terms of each topic by relevance that are neither too common nor too even."""
    order = Window.partitionBy("topic").orderBy(F.desc("relevance"), "term")
    kept = lifted.filter((F.col("df_pct") <= most_df) & (F.col("lift") >= least_lift))
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("topic", "rank", "term", "lift", "relevance")


def bigram_keywords(terms: DataFrame, least_df: int = 15, least_share: float = 0.35, top: int = 15) -> DataFrame:
    """Pairs in enough documents of which one topic has a large share."""
    by_term = Window.partitionBy("term")
    rows = terms.withColumns({"df_all": F.sum("df").over(by_term), "share": F.col("df") / F.sum("df").over(by_term)}).filter((F.col("df_all") >= least_df) & (F.col("share") >= least_share))
    best = rows.groupBy("term").agg(F.max(F.struct("share", "topic", "df_all")).alias("x")).select("term", "x.*")
    order = Window.partitionBy("topic").orderBy(F.desc("df_all"), "term")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("topic", "rank", "term", "df_all", F.round("share", 6).alias("share"))


def keyword_owners(scored: DataFrame) -> DataFrame:
    """Each keyword's topic: the one it scores best in; ``n_topics`` over 1 is a collision."""
    best = scored.groupBy("term").agg(F.max(F.struct("lift", "topic")).alias("x"), F.count(F.lit(1)).alias("n_topics"))
    return best.select("term", F.col("x.topic").alias("topic"), F.col("x.lift").alias("lift"), "n_topics")


def keyword_map(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("term")), ",").alias("keywords"), F.count(F.lit(1)).alias("n"))


def dominant_topic(weights: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, weights array -> the first topic of greatest weight, -1 where that is below ``least``."""
    top = F.array_max("weights")
    return weights.select("doc_id", F.when(top >= least, F.array_position("weights", top) - 1).otherwise(F.lit(-1)).cast("long").alias("topic"), F.round(top, 6).alias("weight"))


def topic_weights(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """doc_id, topic, weight: the share of a document's keyword tokens that each topic owns."""
    rows = texts.select("doc_id", F.explode(tokens(clean_ascii(F.col("text")))).alias("term")).join(owners.select("term", "topic"), "term")
    counts = rows.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")))


def assigned(texts: DataFrame, owners: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, topic of greatest weight if that is ``least`` at least."""
    best = topic_weights(texts, owners).groupBy("doc_id").agg(F.max(F.struct("weight", "topic")).alias("x"))
    return best.select("doc_id", F.when(F.col("x.weight") >= least, F.col("x.topic")).alias("topic"))


def assignment_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents that both assignments cover, and how many of them agree."""
    both = a.filter("topic is not null").join(b.select("doc_id", F.col("topic").alias("other")).filter("other is not null"), "doc_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("topic") == F.col("other")).alias("n_same")).withColumn("agreement_pct", percent(F.col("n_same"), F.col("n")))


def u_mass(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Coherence of each topic's ranked terms: mean over pairs of ln((D(a, b) + 1) / D(b)), b ranked before a."""
    words = texts.select("doc_id", F.explode(F.array_distinct(tokens(clean_ascii(F.col("text"))))).alias("term"))
    hits = words.join(F.broadcast(chosen.select("topic", "rank", "term")), "term")  # some terms per topic
    listed = hits.groupBy("doc_id", "topic").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    single = hits.groupBy("topic", F.col("rank").alias("b")).agg(F.count(F.lit(1)).alias("n_b"))
    pairs = listed.select("topic", F.explode("ranks").alias("b"), "ranks").select("topic", "b", F.explode("ranks").alias("a")).filter("a > b").groupBy("topic", "a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    every = chosen.select("topic", F.col("rank").alias("a")).join(chosen.select("topic", F.col("rank").alias("b")), "topic").filter("a > b")
    rows = every.join(single, ["topic", "b"], "left").join(pairs, ["topic", "a", "b"], "left")
    term = F.ln((F.coalesce("n_ab", F.lit(0)) + 1) / F.col("n_b"))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(term), 6).alias("u_mass"))


def smallest_near_best(scores: DataFrame, slack: float = 0.005) -> DataFrame:
    """The least k whose coherence is within ``slack`` of the best."""
    rows = scores.withColumn("best", F.max("coherence").over(Window.partitionBy())).filter(F.col("coherence") >= F.col("best") - slack)
    return rows.agg(F.min("k").alias("k"), F.max("best").alias("best"))


def ngram_table(texts: DataFrame, order: int, least_df: int = 10, top: int = 30) -> DataFrame:
    """Top n-grams of an order with term frequency, document frequency and share of documents."""
    n = F.broadcast(texts.agg(F.count(F.lit(1)).alias("n")))  # one row
    rows = topic_terms(texts.withColumn("__all", F.lit(0)), "__all", order).filter(F.col("df") >= least_df)
    ranked = rows.orderBy(F.desc("tf"), "term").limit(top)
    return ranked.join(n).select(F.lit(order).alias("n_gram"), "term", "tf", "df", percent(F.col("df"), F.col("n")).alias("df_pct"))


def corpus_stats(texts: DataFrame, least: int = 5) -> DataFrame:
    """Size of the corpus of negative texts of at least ``least`` words."""
    rows = texts.filter("label = 0").withColumn("w", F.size(tokens(clean_ascii(F.col("text"))))).filter(F.col("w") >= least)
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").cast("long").alias("n_tokens"), half_up(F.avg("w")).alias("mean_words"), F.countDistinct(F.md5("text")).alias("n_texts"))


def top_features(log_ratios: DataFrame, top: int = 20) -> DataFrame:
    """The terms that speak most for either class."""
    rows = log_ratios.select("term", "log_ratio", F.explode(F.array(F.lit("positive"), F.lit("negative"))).alias("class"))
    signed = F.when(F.col("class") == "positive", F.col("log_ratio")).otherwise(-F.col("log_ratio"))
    order = Window.partitionBy("class").orderBy(signed.desc(), "term")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("class", "rank", "term", "log_ratio")


def artifact_audit(features: DataFrame) -> DataFrame:
    """Features by class that hold digits, marks, or one-letter words."""
    one = F.exists(F.split("term", " "), lambda x: F.length(x) == 1)
    return features.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term").rlike("[0-9]")).alias("with_digit"), F.count_if(F.col("term").rlike("[^a-z0-9 ]")).alias("with_mark"), F.count_if(one).alias("with_letter"))


def tfidf(texts: DataFrame, least: int = 3, most: int = 30_000) -> DataFrame:
    """Words and pairs of neighbours on white space, case kept: sublinear tf, smooth idf, one unit a document; the ``most`` terms with the greatest corpus count, ties by term."""
    words = texts.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", F.explode(F.concat("w", bigrams(F.col("w")))).alias("term"))
    counts = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).filter(F.col("df") >= least)
    chosen = stats.orderBy(F.desc("n"), "term").limit(most)
    total = F.broadcast(texts.agg(F.count(F.lit(1)).alias("docs")))  # one row
    idf = chosen.join(total).select("term", (F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = counts.join(F.broadcast(idf), "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))  # ``most`` rows
    norm = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, "doc_id").select("doc_id", "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


# ranking over time


def ranking(pairs: DataFrame) -> DataFrame:
    """Categories with reviews, likes, share of all negative reviews, and the gap of their two ranks."""
    negative = pairs.filter("pred_label = 0")
    totals = negative.groupBy("kategori").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"))
    distinct = F.broadcast(negative.agg(F.countDistinct("review_id").alias("n_all")))  # one row
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "kategori")).cast("long")
    return totals.join(distinct).select("kategori", "n", "likes", percent(F.col("n"), F.col("n_all")).alias("share"), rank("n").alias("rank_n"), rank("likes").alias("rank_likes"), (rank("n") - rank("likes")).alias("gap"))


def trend_with_partial(pairs: DataFrame, monthly: DataFrame) -> DataFrame:
    rows = pairs.groupBy(month("tanggal").alias("bulan"), "kategori").agg(F.count(F.lit(1)).alias("jumlah"))
    return rows.join(F.broadcast(monthly.select("bulan", "periode_parsial")), "bulan")  # a row per month


def first_last_year(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Category share of negative reviews in the first and the last twelve months."""
    rows = pairs.filter("pred_label = 0").join(F.broadcast(bounds))  # one row
    early, late = F.col("tanggal") < F.add_months("lo", 12), F.col("tanggal") >= F.add_months("hi", -12)
    out = rows.groupBy("kategori").agg(F.count_if(early).alias("n_first"), F.count_if(late).alias("n_last"))
    total = F.broadcast(rows.agg(F.countDistinct(F.when(early, F.col("review_id"))).alias("all_first"), F.countDistinct(F.when(late, F.col("review_id"))).alias("all_last")))  # one row
    return out.join(total).select("kategori", "n_first", "n_last", percent(F.col("n_first"), F.col("all_first")).alias("pct_first"), percent(F.col("n_last"), F.col("all_last")).alias("pct_last"))


def union_coverage(pairs: DataFrame, a: int, b: int) -> DataFrame:
    """Reviews in either of two categories and in both."""
    per = pairs.filter(F.col("kategori_id").isin(a, b)).groupBy("review_id").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_either"), F.count_if(F.col("k") == 2).alias("n_both"))


def share_difference(versions: DataFrame) -> DataFrame:
    """Each version's negative share less that of all versions together, in points."""
    overall = F.sum("neg").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    return versions.select("versi_minor", F.round(100 * (F.col("neg") / F.col("n") - overall), 6).alias("diff_pp"))


def window_tests(windows: DataFrame) -> DataFrame:
    """Before and after of each version: shares, difference in points, its pooled z, one-sided p and Benjamini-Hochberg q."""
    p0, p1 = F.col("neg_before") / F.nullif(F.col("n_before"), F.lit(0)), F.col("neg_after") / F.nullif(F.col("n_after"), F.lit(0))
    pooled = (F.col("neg_before") + F.col("neg_after")) / (F.col("n_before") + F.col("n_after"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(F.col("n_before"), F.lit(0)) + 1 / F.nullif(F.col("n_after"), F.lit(0))))
    rows = windows.select("versi_minor", "n_before", "n_after", F.round(100 * p0, 6).alias("pct_before"), F.round(100 * p1, 6).alias("pct_after"), F.round(100 * (p1 - p0), 6).alias("delta_pp"), ((p1 - p0) / F.nullif(se, F.lit(0.0))).alias("z"))
    return release.with_q(rows).withColumns({c: F.round(c, 6) for c in ("z", "p", "q")})


def left_censored(versions: DataFrame, bounds: DataFrame, days: int = 28) -> DataFrame:
    """Versions that appeared so soon after the data begin that their first day is not known."""
    return versions.join(F.broadcast(bounds)).select("versi_minor", (F.col("t0") < F.col("lo") + F.expr(f"interval {days} days")).alias("censored"))  # one row


def dual_flags(first: DataFrame, second: DataFrame, least_pp: float = 5.0, alpha: float = 0.05) -> DataFrame:
    """Versions flagged, by points and q, for two labels of the same reviews, and by both."""
    mark = lambda t, name: release.flags(release.with_q(t), least_pp, alpha).select("versi_minor", F.col("flag").alias(name))
    rows = mark(first, "by_prediction").join(mark(second, "by_rating"), "versi_minor", "left").fillna(False, ["by_rating"])
    return rows.withColumn("by_both", F.col("by_prediction") & F.col("by_rating"))


def chi_square_p(chi2: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for one number; ``expr.chi_square_upper`` is the column expression."""
    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series of the lower tail
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300  # continued fraction of the upper tail
    d = h = 1 / b
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


# serving additions


def kpi_full(kpi: DataFrame, by_version: DataFrame, meta: DataFrame) -> DataFrame:
    """The KPI row with the number of versions and the share without one (neither heeds the dates), and what the client derives."""
    versions = by_version.agg(F.count(F.lit(1)).alias("n_versi"))
    row = kpi.join(F.broadcast(versions)).join(F.broadcast(meta.select("versi_null_pct")))  # one row each
    return row.withColumns({"selisih_model_aktual": half_up(F.col("persen_negatif_model") - F.col("persen_negatif_aktual")), "persen_positif": half_up(100 - F.col("persen_negatif_model"))})


def version_coverage_pct(by_version: DataFrame, meta: DataFrame, least: int) -> DataFrame:
    """Reviews of the versions listed, as shares of the reviews with a version and of all."""
    shown = by_version.filter(F.col("total_ulasan") >= least).agg(F.count(F.lit(1)).alias("n_versi"), F.coalesce(F.sum("total_ulasan"), F.lit(0)).alias("n_ulasan"))
    return shown.join(F.broadcast(meta)).select("n_versi", "n_ulasan", percent(F.col("n_ulasan"), F.col("n_versi_minor_terisi")).alias("pct_of_versioned"), percent(F.col("n_ulasan"), F.col("total_ulasan")).alias("pct_of_all"))  # one row


def displayed(rows: DataFrame) -> DataFrame:
    """Counts with dots between thousands, shares with a comma, months as ``MM-yyyy``."""
    return rows.select("bulan", F.translate(F.format_number("total_ulasan", 0), ",", ".").alias("total"), F.concat(F.translate(F.format_string("%.2f", "persen_negatif"), ".", ","), F.lit("%")).alias("persen"), F.date_format("bulan", "MM-yyyy").alias("periode"))


def nested_metrics(metrics: DataFrame) -> DataFrame:
    """One JSON list of (model, macro-F1) per evaluation set, the baseline first."""
    item = F.struct((F.col("model_name") != "majority_baseline").cast("int").alias("k"), (-F.col("macro_f1")).alias("f"), "model_name")
    return metrics.groupBy("eval_set").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["model_name"]), ",").alias("models"), F.count(F.lit(1)).alias("n"))


def predict(texts: DataFrame, log_ratios: DataFrame, prior: float = 0.0) -> DataFrame:
    """doc_id, text -> the multinomial score by the terms' log ratios, its label, confidence and number of known tokens."""
    words = texts.select("doc_id", F.explode(tokens(clean_ascii(F.col("text")))).alias("term"))
    hits = words.join(log_ratios.select("term", "log_ratio"), "term").groupBy("doc_id").agg(F.sum("log_ratio").alias("s"), F.count(F.lit(1)).alias("n_known"))
    rows = texts.select("doc_id").join(hits, "doc_id", "left").select("doc_id", (F.coalesce("s", F.lit(0.0)) + prior).alias("s"), F.coalesce("n_known", F.lit(0)).alias("n_known"))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("s")))))
    return rows.select("doc_id", "n_known", (F.col("s") >= 0).cast("int").alias("pred"), F.round(F.greatest(p, 1 - p), 4).alias("confidence"))
