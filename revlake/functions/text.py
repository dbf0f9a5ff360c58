"""Text normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words of the language flag, in two languages; words a trimmed ending must not touch; the patterns of
# URLs, mentions, non-ASCII, digits, punctuation, repeats and white space below.
ENGLISH = tuple(
    """
the to and i a it is my of for you this not but that with be was are have they
me your can so very in on at just when or if from no all what there more
because too even after would will dont don't cant can't it's i'm im their them
our we us has had been than only also really still always never every
""".split()
)
INDONESIAN = tuple(
    """
dan yang di ke dari tidak ga gak nggak ngga gk tdk ini itu saya aku nya ada
bisa sudah udah sangat banget tapi untuk dengan kalau kalo mau lagi juga sih
aja saja jadi karena krn yg dgn sama buat kok deh dong apa kenapa mohon tolong
belum blm masih harus
""".split()
)
KEEP_ENDINGS = ("bill", "ss", "pbb", "cc")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_ascii(text: Column) -> Column:
    """Lower case; URLs, mentions, non-ASCII, digits and punctuation go; white space collapses."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # What is neither a letter a-z nor white space covers non-ASCII, digits and punctuation in one pass.
    for pattern in (r"https?://\S+|www\.\S+", r"[@#][\p{L}\p{N}_]+", r"[^a-z\s]+"):
        t = F.regexp_replace(t, pattern, " ")
    return squeeze(t)


def collapse_repeats(text: Column) -> Column:
    """Runs of three or more equal characters become one."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1")


def trim_doubled_endings(text: Column, keep: tuple[str, ...] = KEEP_ENDINGS) -> Column:
    """Doubled letters at word ends become one, but for words in ``keep``."""
    kept = F.array(*map(F.lit, keep))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(F.array_contains(kept, w), w).otherwise(F.regexp_replace(w, r"(\w)\1+$", "$1"))), " ")


def clean_full(text: Column) -> Column:
    return squeeze(trim_doubled_endings(collapse_repeats(clean_ascii(text))))


def tokens(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without(words: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def bigrams(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))


def language_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_en, n_id and is_english (at least 3 words, 2 English ones, over twice the Indonesian)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z']+"), F.lit(0))
    df = df.withColumn("__words", words)
    count = lambda listed: F.size(F.filter("__words", lambda w: w.isin(*listed))).cast("long")
    df = df.withColumns({"n_words": F.size("__words").cast("long"), "n_en": count(ENGLISH), "n_id": count(INDONESIAN)}).drop("__words")
    return df.withColumn("is_english", (F.col("n_words") >= 3) & (F.col("n_en") >= 2) & (F.col("n_en") > 2 * F.col("n_id")))
