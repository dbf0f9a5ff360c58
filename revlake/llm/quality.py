"""Operator 1, quality rules by a hashed n-gram likelihood ratio (DataFrame operations only).

A text's n-grams are its words, its pairs of neighbouring words and the last two characters of
its words, each hashed into one of ``BUCKETS`` buckets.  Two multinomials with add-one
smoothing are counted: the target over trusted documents, the raw one over all documents.  A
document's score is the mean over its n-grams of log p_target - log p_raw, and it passes from
``THRESHOLD`` up.  The base rule rejects texts of under 10 words and texts of which over a
fifth of the words stand in repeated 5-word windows.

Trusted documents are those labelled of good quality, at most ``TRUSTED`` of them (the first by
MD5 of their id), so that their ids can be broadcast; everything else is counted over all rows.
The only other thing that leaves the executors is the table of bucket counts, which has
``BUCKETS`` rows.  All measures are expressions over one row: no row is shuffled.  Windows that
agree in a 64-bit hash of the five words' CRC-32 are then compared by their words.

Rows: null and empty texts have no words and fail.  Repeated rows are rows of their own; an
empty table gives no rows; other columns are ignored (``kept_documents`` carries them through).
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import WORD, quoted

BUCKETS, TRUSTED, THRESHOLD = 1 << 14, 100_000, -0.15
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def split_words(text: Column) -> Column:
    """As ``common.words``: a split at single spaces costs about half of a pattern's matches."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def hashes(found: str) -> tuple[Column, Column]:
    """CRC-32 of the words of a plain words column, and the hashes of their last two characters."""
    return F.transform(found, lambda w: F.crc32(w.cast("binary"))), F.expr(f"transform({found}, w -> crc32(cast(right(w, 2) as binary)) * 37 + 1)")


def grams(crc: str, last: str) -> Column:
    """Hashes of all n-grams; the low bits name the bucket."""
    rest = F.greatest(F.size(crc) - 1, F.lit(0))
    return F.concat(crc, F.zip_with(F.slice(crc, F.lit(1), rest), F.slice(crc, F.lit(2), rest), lambda a, b: a * 31 + b), last)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """At most TRUSTED ids of documents of good quality."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(TRUSTED)


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log p_target - log p_raw of every bucket.

    Words become rows before they are hashed, so that hashing and counting stay in generated code.
    """
    trusted = F.broadcast(trusted_ids(labels).withColumn("good", F.lit(1)))  # TRUSTED rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split_words(F.col("text")).alias("w")).join(trusted, "doc_id", "left")
    found = found.select("good", F.explode(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(0))).alias("next"))).alias("x"))
    crc = lambda c: F.crc32(c.cast("binary"))
    found = found.select("good", crc(F.col("x.w")).alias("c"), crc(F.col("x.next")).alias("n"), crc(F.right(F.col("x.w"), F.lit(2))).alias("e"))
    found = found.select("good", F.explode(F.array(F.col("c"), F.col("c") * 31 + F.col("n"), F.col("e") * 37 + 1)).alias("g")).filter("g is not null")
    counted = found.groupBy(F.col("g").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.count("good").alias("target"), F.count(F.lit(1)).alias("raw"))
    target, raw = [0] * BUCKETS, [0] * BUCKETS
    for r in counted.collect():  # one row per bucket
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    of_target, of_raw = sum(target) + BUCKETS, sum(raw) + BUCKETS
    return [math.log((t + 1) / of_target) - math.log((r + 1) / of_raw) for t, r in zip(target, raw)]


def measured(docs: DataFrame, weights: list[float]) -> DataFrame:
    """The row as ``__doc``, and its measures, ``score``, ``base_failed`` and ``kept``.

    Each step is a projection of its own: what a lambda refers to must be a plain column, or it
    would be worked out again for every element.
    """
    text = F.coalesce(F.col("__doc.text"), F.lit(""))
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    held = docs.select(F.struct(*quoted(docs)).alias("__doc"))
    held = held.select("__doc", split_words(F.col("__doc.text")).alias("__w"))
    crc, last = hashes("__w")
    held = held.select("__doc", "__w", F.size("__w").cast("long").alias("n_words"), crc.alias("__c"), last.alias("__e"))
    held = held.select("__doc", "__w", "n_words", "__c", grams("__c", "__e").alias("__g"))
    window = lambda i: F.xxhash64(*(F.get(F.col("__c"), i + k) for k in range(5)))
    windows = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("__c") - 5), window)).otherwise(F.array().cast("array<long>"))
    summed = F.aggregate("__g", F.lit(0.0), lambda a, g: a + F.get(table, g.bitwiseAND(BUCKETS - 1).cast("int")))
    held = held.select("__doc", "__w", "n_words", windows.alias("__v"), summed.alias("__sum"), F.size("__g").alias("__n"))
    twice = F.size(F.array_distinct("__v")) < F.size("__v")
    held = held.select("__doc", "__w", "n_words", "__sum", "__n", F.when(twice, F.sort_array(F.transform("__v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).alias("__s"))

    def positions(by: str) -> Column:
        """Positions of the entries of a sorted column of (v, i) whose v is a neighbour's too."""
        same = lambda s, k: F.when((F.get(F.col(by), k - 1)["v"] == s["v"]) | (F.get(F.col(by), k + 1)["v"] == s["v"]), s["i"])
        return F.when(F.col(by).isNotNull(), F.sort_array(F.filter(F.transform(by, same), lambda i: i.isNotNull())))

    held = held.select("__doc", "__w", "n_words", "__sum", "__n", positions("__s").alias("__hit"))
    # What hashes found is compared word by word.
    held = held.withColumn("__s", F.sort_array(F.transform("__hit", lambda i: F.struct(F.concat_ws(" ", F.slice(F.col("__w"), i + 1, F.lit(5))).alias("v"), i.alias("i")))))
    held = held.withColumn("__at", positions("__s"))
    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("__at", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    held = held.select("__doc", "n_words", F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"), lines.alias("__lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).otherwise(0.0).alias("score"))
    held = held.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return held.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= THRESHOLD))


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept, score (rounded to 6 places): one row per document."""
    out = measured(docs.select("doc_id", "text"), ratios(docs, labels))
    return out.select(F.col("__doc.doc_id").cast("long").alias("doc_id"), *MEASURES, "base_failed", "kept", F.round("score", 6).alias("score"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    The row number is never negative.  It keeps the filter above the measures: pushed below, it
    would hold all their expressions in one, and work out what a lambda refers to again and again.
    """
    found = measured(docs, ratios(docs, labels)).select("__doc", "kept", F.monotonically_increasing_id().alias("__row"))
    return found.filter("kept and __row >= 0").select("__doc.*")


ORACLE_SQL = rf"""
with crc_table as (select list(v order by i) as crc from (
  select i, list_reduce(list_prepend(i::bigint, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) r(i))),
d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
u as materialized (select r, doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from d),
s as (select distinct w from (select w from u union all select right(w, 2) from u)),
c as materialized (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::bigint)),
  lambda a, b: xor(a >> 8, crc_table.crc[(xor(a, b) & 255) + 1])), 4294967295) as c from s, crc_table),
h as materialized (select u.r, u.doc_id, u.i, u.w, a.c as c, b.c as e, lead(a.c) over (partition by u.r order by u.i) as nx from u join c a on a.w = u.w join c b on b.w = right(u.w, 2)),
g as materialized (select r, doc_id, c % {BUCKETS} as b from h union all select r, doc_id, (c * 31 + nx) % {BUCKETS} from h where nx is not null union all select r, doc_id, (e * 37 + 1) % {BUCKETS} from h),
good as (select distinct doc_id, md5(doc_id::varchar) as m from labels where quality = 1 and doc_id is not null order by m, doc_id limit {TRUSTED}),
k as (select b, count(*) filter (where doc_id in (select doc_id from good)) as t, count(*) as n from g group by b),
wt as (select b, ln((t + 1)::double / ((select sum(t) from k) + {BUCKETS})::double) - ln((n + 1)::double / ((select sum(n) from k) + {BUCKETS})::double) as x from k),
sc as (select r, sum(x) / count(*) as score from g join wt using (b) group by r),
v as (select r, i, hash_text, count(*) over (partition by r, hash_text) as n from (
  select r, i, w || chr(10) || lead(w, 1) over o || chr(10) || lead(w, 2) over o || chr(10) || lead(w, 3) over o || chr(10) || lead(w, 4) over o as hash_text from u window o as (partition by r order by i)) where hash_text is not null),
rep as (select r, count(distinct i + j) as n from v, range(5) x(j) where v.n > 1 group by r),
ln as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (select d.doc_id, len(d.w)::bigint as n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::bigint as word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols,
  coalesce(ln.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(sc.score, 0) as s
  from d left join rep using (r) left join ln using (r) left join sc using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and s >= {THRESHOLD} as kept, round(s, 6) as score from m"""
