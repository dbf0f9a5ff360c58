"""Release-over-release statistics.  There is one row per version throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions.expr import chi_square_upper, normal_upper, version_key


def by_version(labelled: DataFrame, least: int = 100) -> DataFrame:
    """versi_minor, n, neg, t0 from rows with a label column; versions with enough rows."""
    rows = labelled.filter("versi_minor is not null and label is not null")
    return rows.groupBy("versi_minor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("neg"), F.min("tanggal").alias("t0")).filter(F.col("n") >= least)


def z_tests(versions: DataFrame) -> DataFrame:
    """One-sided pooled z of each version against the one before it in numeric order."""
    order = Window.orderBy(version_key("versi_minor"))
    rows = versions.withColumns({"n0": F.lag("n").over(order), "neg0": F.lag("neg").over(order)})
    pooled = (F.col("neg") + F.col("neg0")) / (F.col("n") + F.col("n0"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("n0")))
    p1, p0 = F.col("neg") / F.col("n"), F.col("neg0") / F.col("n0")
    return rows.withColumns({"delta_pp": 100 * (p1 - p0), "z": (p1 - p0) / F.nullif(se, F.lit(0.0))})


def with_q(tests: DataFrame) -> DataFrame:
    """Adds p of the z and its Benjamini-Hochberg q; rows without p take no part."""
    rows = tests.withColumn("p", normal_upper("z"))
    return bh(rows, "p", "q")


def bh(rows: DataFrame, p: str, q: str) -> DataFrame:
    valid = F.col(p).isNotNull()
    ranked = rows.withColumns({"__r": F.row_number().over(Window.partitionBy(valid).orderBy(p)), "__n": F.count(p).over(Window.partitionBy())})
    upward = Window.partitionBy(valid).orderBy("__r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    raw = F.col(p) * F.col("__n") / F.col("__r")
    return ranked.withColumn(q, F.when(valid, F.least(F.lit(1.0), F.min(raw).over(upward)))).drop("__r", "__n")


def flags(tests: DataFrame, least_pp: float = 5.0, alpha: float = 0.05) -> DataFrame:
    return tests.withColumn("flag", F.coalesce((F.col("delta_pp") >= least_pp) & (F.col("q") < alpha), F.lit(False)))


def chi_square(versions: DataFrame) -> DataFrame:
    """Homogeneity of the negative share over versions: statistic, degrees of freedom and p."""
    everything = Window.partitionBy()
    share = F.sum("neg").over(everything) / F.sum("n").over(everything)
    expected = F.col("n") * share
    term = F.pow(F.col("neg") - expected, F.lit(2.0)) / expected + F.pow(F.col("neg") - expected, F.lit(2.0)) / (F.col("n") - expected)
    row = versions.select(term.alias("t")).agg(F.sum("t").alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    return row.withColumn("p", chi_square_upper(F.col("chi2"), F.col("dof")))


def windows(labelled: DataFrame, versions: DataFrame, days: int = 28) -> DataFrame:
    """Reviews and negative ones in the days before and after each version first appeared.

    The range join runs on weeks: a version meets only the rows of the weeks that its two
    windows touch.
    """
    span = F.expr(f"interval {days} days")
    rows = labelled.filter("label is not null").select("tanggal", "label", F.to_date(F.date_trunc("WEEK", "tanggal")).alias("w"))
    first, last = F.to_date(F.date_trunc("WEEK", F.col("t0") - span)), F.to_date(F.date_trunc("WEEK", F.col("t0") + span))
    spots = versions.select("versi_minor", "t0", F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("w"))
    weekly = rows.groupBy("w", "tanggal", "label").agg(F.count(F.lit(1)).alias("k"))  # equal instants are counted before they meet versions
    before = (F.col("tanggal") >= F.col("t0") - span) & (F.col("tanggal") < F.col("t0"))
    after = (F.col("tanggal") >= F.col("t0")) & (F.col("tanggal") < F.col("t0") + span)
    k = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    return spots.join(weekly, "w").groupBy("versi_minor").agg(k(before).alias("n_before"), k(before & (F.col("label") == 0)).alias("neg_before"), k(after).alias("n_after"), k(after & (F.col("label") == 0)).alias("neg_after"))


def composition(pairs: DataFrame, reviews: DataFrame, flagged: DataFrame) -> DataFrame:
    """Share of distinct negative reviews by category: flagged versions and all."""
    marked = reviews.select(F.col("id").alias("review_id"), "versi_minor").join(flagged.select("versi_minor", F.lit(1).alias("f")), "versi_minor", "left").select("review_id", "f")
    rows = pairs.filter("pred_label = 0").join(marked, "review_id").groupBy("kategori").agg(F.count("f").alias("n_flagged"), F.count(F.lit(1)).alias("n_all"))
    everything = Window.partitionBy()
    return rows.select("kategori", "n_flagged", "n_all", F.round(100.0 * F.col("n_flagged") / F.nullif(F.sum("n_flagged").over(everything), F.lit(0)), 6).alias("pct_flagged"), F.round(100.0 * F.col("n_all") / F.sum("n_all").over(everything), 6).alias("pct_all"))
