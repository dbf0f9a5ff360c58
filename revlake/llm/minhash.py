"""Operator 3, near-duplicate texts by improved consistent weighted sampling.

A text's features are its runs of ``SHINGLE`` words (all its words if it has fewer), in ASCII
lower case, as 64-bit hashes.  A feature weighs (1 + ln tf) * (1 + IDF_SHARE * idf), where idf
is the logarithm of the share of rows with the feature, scaled to 0..1.  Document frequencies
are counted over all rows in ``DF_BUCKETS`` hashed buckets, a table of fixed size.  The idf part
is small on purpose: in a text with very many copies the few edited words would otherwise
outweigh all that is shared.

Each text has ``BANDS`` x ``ROWS`` samples.  The generators' draws (gamma, gamma, uniform) come
from tables of their quantiles, addressed by bits of a hash of feature and sample, so that equal
features draw alike everywhere.  A band's samples make a bucket.

Equal texts are one text before anything is compared.  In a bucket some texts lead: each is
compared with the texts of the bucket that are in another component, by weighted Jaccard
similarity over all features.  The least text leads first; after each step components are
worked out anew, and in buckets that still hold several of them four times as many lead, while
that leaves less to compare.  Texts that meet one of the leaders, directly or by a chain of
links, are never compared with each other, so a group of near copies takes comparisons in
proportion to its size.  Texts that link with none of the leaders are compared with all others
of the bucket, in blocks of ``BLOCK`` by products of matrices: no pair is a row.
A pair is not compared if its total weights alone rule a link out, or if under ``AGREE`` of its
samples agree: at the similarity of a link that has a probability of 3e-5, less than that of
sharing no bucket (2e-4).  Members of a bucket are dealt in parts of about ``PART`` texts, each
with its own copies of the leaders, so no task holds a bucket.

Rows: null is the empty text; empty texts equal each other.  Different texts of one doc_id are
compared as texts of their own; class_id is the least doc_id of a class, and of each class the
text of that doc_id (the least MD5, if several) stays.  Rows without a doc_id have no class
(class_id null) and are kept.  An
empty table gives no rows; other columns are ignored (``kept_documents`` carries them through).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import quoted, written
from revlake.llm.graph import components, join_hubs, local_roots

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
DF_BUCKETS, IDF_SHARE = 1 << 18, 0.1
AGREE = 18
PART = 128
#: Texts of a block, and features of a block that are multiplied at once.
BLOCK, COLUMNS = 512, 2048
SEED = 20240502
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the features, with repeats."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes split at ASCII white space only
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(SHINGLE, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _MIX + h[k : k + len(out)]
        return _mixed(out + np.uint64(width))


def _buckets(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(40)).astype(np.int64) % DF_BUCKETS


def weighted(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features in order and their weights."""
    features, tf = np.unique(shingles(text), return_counts=True)
    return features, (1 + np.log(tf)) * idf[_buckets(features)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; two texts without features are equal."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    shared = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(shared / (total - shared))


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with tabled draws."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        n = 1 << 16
        u = (np.arange(n) + 0.5) / n
        # Quantiles of gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection.
        low, high = np.zeros(n), np.full(n, 40.0)
        for _ in range(60):
            mid = (low + high) / 2
            under = 1 - (1 + mid) * np.exp(-mid) < u
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        gamma = (low + high) / 2
        self.r, self.ln_c, self.beta = gamma.astype(np.float32), np.log(gamma).astype(np.float32), u.astype(np.float32)
        self.seeds = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    def bands(self, features: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys (texts, BANDS) and samples (texts, BANDS * ROWS) of non-empty texts whose features begin at ``starts``."""
        ln_w = np.log(weights).astype(np.float32)
        keys = np.zeros((len(starts), BANDS), np.uint64)
        samples = np.zeros((len(starts), BANDS * ROWS), np.uint32)
        mask = np.uint64(0xFFFF)
        with np.errstate(over="ignore"):
            for k, seed in enumerate(self.seeds):
                z = _mixed((features ^ seed) * _MIX)
                r, beta = self.r[z >> np.uint64(48)], self.beta[(z >> np.uint64(16)) & mask]
                t = np.floor(ln_w / r + beta)
                ln_a = self.ln_c[(z >> np.uint64(32)) & mask] - r * (t - beta + 1)
                order = ln_a.view(np.int32).astype(np.int64)
                order ^= (order >> 63) & 0x7FFFFFFF  # floats in the order of integers
                name = (z ^ (t.astype(np.int64).view(np.uint64) * _MIX)) >> np.uint64(32)
                least = np.minimum.reduceat((order << 32) | name.view(np.int64), starts)
                samples[:, k] = least.view(np.uint64) & np.uint64(0xFFFFFFFF)
                band = k // ROWS
                keys[:, band] = _mixed(keys[:, band] * _MIX + samples[:, k].astype(np.uint64) + np.uint64(band + 1))
        return keys, samples


def idf_of(df: np.ndarray, total: int) -> np.ndarray:
    """Weight factor of each bucket from the number of rows with one of its shingles.

    Shingles of few rows share a bucket with others; the median bucket tells how many.  What
    exceeds it by more than four standard deviations of such a count is a shingle of that many
    rows, all others count as shingles of one.  The error as a share of all rows falls with
    the square root of their number.
    """
    usual = np.median(df)
    above = df - usual
    df = np.where(above > 4 * math.sqrt(usual + 1), above, 1)
    return 1 + IDF_SHARE * np.log((total + 1) / (df + 1)) / np.log(total + 1)


def _idf(docs: DataFrame) -> np.ndarray:
    """Weight factor of each bucket, from document frequencies over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[np.unique(_buckets(shingles(text.as_py())))] += 1
            n += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # DF_BUCKETS + 1 rows at most
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    df = np.zeros(DF_BUCKETS + 1, np.int64)
    df[bucket] = n  # -1 is the number of rows
    return idf_of(df[:-1], max(1, df[-1]))


def _signed(docs: DataFrame, idf) -> DataFrame:
    """doc_id, key (MD5 of the text), bands and samples (null where the text has no features), weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()

        def signatures(group: list[tuple[np.ndarray, np.ndarray]]) -> list:
            full = [g for g in group if len(g[0])]
            if not full:
                return [(None, None, 0.0)] * len(group)
            starts = np.cumsum([0, *(len(f) for f, _ in full[:-1])])
            keys, samples = sampler.bands(np.concatenate([f for f, _ in full]), np.concatenate([w for _, w in full]), starts)
            found = zip(keys.view(np.int64), samples.view(np.int32), (float(w.sum()) for _, w in full))
            return [next(found) if len(g[0]) else (None, None, 0.0) for g in group]

        for batch in batches:
            rows, group, size = [], [], 0
            for text in batch.column(2):
                group.append(weighted(text.as_py(), idf.value))
                size += len(group[-1][0])
                if size > 40_000:  # working arrays stay in cache
                    rows += signatures(group)
                    group, size = [], 0
            rows += signatures(group)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int32()), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "key", "bands", "samples", "weight"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
    return given.mapInArrow(run, "doc_id long, key string, bands array<long>, samples array<int>, weight double")


def _may_link(one: str, two: str):
    """Neither weights nor samples rule the pair out."""
    a, b = F.col(f"{one}.weight"), F.col(f"{two}.weight")
    agree = F.size(F.filter(F.zip_with(f"{one}.samples", f"{two}.samples", lambda x, y: x == y), lambda e: e))
    return (F.least(a, b) >= SIMILARITY * F.greatest(a, b) * (1 - 1e-9)) & (agree >= AGREE)


def _compared(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, parts, part, b) pairs and (id, text) -> (a, b) of the pairs that are a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, None
        for batch in batches:
            a, b = [], []
            for *group, two, text in zip(*(c.to_pylist() for c in batch.columns)):
                if two is None:
                    at, base = group, weighted(text, idf.value)
                else:
                    assert at == group, "the text to compare with comes first"
                    if similarity(base, weighted(text, idf.value)) >= SIMILARITY:
                        a.append(group[0])
                        b.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    members = pairs.join(texts.withColumnRenamed("id", "b"), "b").select("a", "parts", "part", "b", "text")
    leaders = pairs.select("a", "parts", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "parts", "part", F.lit(None).cast("long").alias("b"), "text")
    dealt = members.unionByName(leaders).repartition("a", "parts", "part").sortWithinPartitions("a", "parts", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _candidates(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) of the texts, each from one of its rows."""
    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.md5(text).alias("key"), text.alias("text"))
    found = given.join(texts.select("id", "first_id", "key", "rows").hint("shuffle_hash"), ["first_id", "key"])
    once = found.filter("rows = 1").select("id", "text")
    return written(once.unionByName(found.filter("rows > 1").groupBy("id").agg(F.first("text").alias("text"))), "minhash-candidates")


def _met(texts: DataFrame) -> DataFrame:
    """id, band, bucket, n, least: the entries of buckets that hold several texts, with their number and least id."""
    entries = texts.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")
    return written(entries.join(shared, ["band", "bucket"]), "minhash-buckets")


def _leads(step: int) -> Column:
    """Has the entry led its bucket by this step?  The least text leads first, then four times as many in each step, by a hash, in the end all."""
    if step < 0:
        return F.lit(False)
    drawn = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return (F.col("id") == F.col("least")) | (drawn * F.col("n") < (4.0**step if step else 0.0))


def _step_pairs(met: DataFrame, roots: DataFrame | None, step: int) -> tuple[DataFrame, DataFrame]:
    """Entries of the buckets that still hold several components, and their pairs (lo, hi, a, parts) of this step's leaders with texts of other components."""
    if roots is None:
        near = met.withColumn("root", F.col("id"))
    else:
        near = met.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = near.filter(~_leads(step - 1)).groupBy("band", "bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("band", "bucket")
        near = written(near.join(open_, ["band", "bucket"]), "minhash-open")
    waiting = near.filter(~_leads(step - 1)).withColumn("leads", _leads(step)).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    leaders = waiting.filter("leads").select("band", "bucket", F.col("id").alias("a"), F.col("root").alias("root_a"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = waiting.select("band", "bucket", part.alias("part"), F.col("id").alias("b"), F.col("root").alias("root_b"), "leads")
    pairs = leaders.join(members, ["band", "bucket", "part"]).filter("root_a <> root_b and (not leads or a < b)")
    # Of the buckets that a pair meets in, one decides who leads.
    pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("a", "parts")).alias("x"))
    return near, pairs.select("lo", "hi", "x.*")


def shared_weights(texts: list[str], idf: np.ndarray, cut: int) -> np.ndarray:
    """Similarity of each of the first ``cut`` texts with each of the others (with all but itself, if ``cut`` is their number).

    A feature of frequency tf is tf features that weigh what each raises the weight by, so the
    weight that two texts share is a product of two rows.
    """
    names, steps, rows = [], [], []
    total = np.zeros(len(texts))
    for i, text in enumerate(texts):
        features, tf = np.unique(shingles(text), return_counts=True)
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        weight = np.repeat(idf[_buckets(features)], tf) * np.where(level, np.log1p(level) - np.log(np.maximum(level, 1)), 1.0)
        with np.errstate(over="ignore"):
            names.append(np.repeat(features, tf) + level.astype(np.uint64) * _MIX)
        steps.append(weight)
        rows.append(np.full(len(weight), i))
        total[i] = weight.sum()
    name, step, row = np.concatenate(names), np.concatenate(steps), np.concatenate(rows)
    _, column, times = np.unique(name, return_inverse=True, return_counts=True)
    several = times[column] > 1
    step, row, column = np.sqrt(step[several]), row[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    step, row, column = step[order], row[order], column[order]
    first, second = slice(0, cut), slice(0 if cut == len(texts) else cut, len(texts))
    shared = np.zeros((cut, second.stop - second.start))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(texts), COLUMNS))
        held[row[a:b], column[a:b] - at] = step[a:b]
        shared += held[first] @ held[second].T
    return shared / (total[first, None] + total[None, second] - shared)


def block_links(ids: np.ndarray, roots: np.ndarray, texts: list[str], cut: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the first ``cut`` texts and the others (all, if ``cut`` is their number) of other components, as (id, least id it is linked with by a chain)."""
    n, other = len(ids), 0 if cut == len(ids) else cut
    found = shared_weights(texts, idf, cut)
    linked = np.zeros((n, n), bool)
    linked[:cut, other:] = found >= SIMILARITY
    for i, j in zip(*np.nonzero(np.abs(found - SIMILARITY) < 1e-9)):  # the rounding of one sum decides, as in the steps before
        linked[i, j + other] = similarity(weighted(texts[i], idf), weighted(texts[j + other], idf)) >= SIMILARITY
    linked &= roots[:, None] != roots[None, :]
    linked |= linked.T
    rows = linked.any(1)
    root = local_roots(linked)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return ids[rows], least[root][rows]


def _blocks(near: DataFrame) -> DataFrame:
    """Open entries (band, bucket, id, root) -> band, bucket, i, j, second, id, root: the blocks that meet, and which of the two an entry is in.

    The largest component of a bucket is dealt in blocks of its own, which do not meet each other.
    """
    spot = ["band", "bucket"]
    sizes = near.groupBy(*spot, "root").agg(F.count(F.lit(1)).alias("k")).groupBy(*spot).agg(F.max(F.struct("k", "root")).alias("x"), F.sum("k").alias("k"))
    parts = lambda k: F.ceil(k / BLOCK).cast("int")
    sizes = sizes.select(*spot, F.col("x.root").alias("largest"), parts(F.col("k") - F.col("x.k")).alias("few"), parts(F.col("x.k")).alias("more"))
    dealt = near.select(*spot, "id", "root").join(sizes, spot).withColumn("inner", F.col("root") == F.col("largest"))
    part = F.when(F.col("inner"), F.col("few") + F.pmod(F.xxhash64("id"), F.col("more"))).otherwise(F.pmod(F.xxhash64("id"), F.col("few"))).cast("int")
    every = F.when(F.col("inner"), F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("more") - 1))
    dealt = dealt.withColumn("part", part).select(*spot, "id", "root", "part", F.explode(every).alias("with"))
    return dealt.select(*spot, F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), (F.col("part") > F.col("with")).alias("second"), "id", "root")


def _block_links(blocks: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, b): links between texts of the blocks that meet; no pair is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, ids, roots, held, cut = None, [], [], [], 0

        def links():
            if len(ids) < 2 or spot[2] != spot[3] and not 0 < cut < len(ids):
                return
            a, b = block_links(np.array(ids, np.int64), np.array(roots, np.int64), held, len(ids) if spot[2] == spot[3] else cut, idf.value)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for *at, second, id_, root, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != spot:
                    yield from links()
                    spot, ids, roots, held, cut = at, [], [], [], 0
                ids.append(id_)
                roots.append(root)
                held.append(text)
                cut += not second
        yield from links()

    spot = ["band", "bucket", "i", "j"]
    dealt = blocks.join(texts, "id").repartition(*spot).sortWithinPartitions(*spot, "second").select(*spot, "second", "id", "root", "text")
    return dealt.mapInArrow(run, "a long, b long")


def linked_texts(docs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(id, root) of the texts that are linked with another.

    Leaders are compared in steps while that spares work; a pair that one step has compared is
    not compared again.  What is open then is compared block by block.
    """
    met = _met(texts.filter("bands is not null"))
    ids = met.select("id").distinct()
    candidates = _candidates(docs, texts.join(ids, "id", "left_semi"))
    tests = texts.select("id", "samples", "weight")
    roots, done, step, before = None, None, 0, None
    while True:
        near, pairs = _step_pairs(met, roots, step)
        if near.isEmpty():
            break
        if step > 1:
            blocks = written(_blocks(near), "minhash-blocks")
            work = blocks.count()
            if work < 4 * near.count() or before and work > 0.7 * before:
                found = written(_block_links(blocks, candidates, idf), "minhash-links")
                roots = components(found.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))), "a", "b")
                break
            before = work
        met = near.drop("root")
        if done is not None:
            pairs = pairs.join(done, ["lo", "hi"], "left_anti")
        pairs = written(pairs.withColumn("b", F.col("lo") + F.col("hi") - F.col("a")).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")), "minhash-pairs")
        one = pairs.select("a", "parts", "part").distinct().join(tests.withColumnRenamed("id", "a"), "a").alias("one")
        tested = pairs.join(tests.withColumnRenamed("id", "b"), "b").alias("two").join(one, ["a", "parts", "part"]).filter(_may_link("one", "two")).select("a", "parts", "part", "b")
        new = written(_compared(written(tested, "minhash-tested"), candidates, idf), "minhash-links")
        kept = new if roots is None else new.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = components(kept, "a", "b")
        done = pairs.select("lo", "hi") if done is None else done.unionByName(pairs.select("lo", "hi"))
        step += 1
    return docs.sparkSession.createDataFrame([], "id long, root long") if roots is None else roots


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_key (that text of the class which stays): one row per document row."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(_idf(docs))  # DF_BUCKETS numbers
    rows = written(_signed(docs, idf), "minhash-rows")
    named = rows.filter("doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("bands", "samples", "weight")]
    texts = named.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), *firsts)
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "minhash-texts")  # numbers are read back, so they stay
    roots = linked_texts(docs, texts, idf)
    rooted = written(texts.select("id", "key", "first_id", "rows").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "minhash-rooted")
    total = rooted.agg(F.count(F.lit(1)), F.sum("rows")).first()
    ends = rooted.groupBy("root").agg(F.min(F.struct("first_id", "key")).alias("x"), F.count(F.lit(1)).alias("n")).select("root", F.col("x.first_id").alias("class_id"), F.col("x.key").alias("class_key"), "n")
    of_text = join_hubs(rooted.select("root", "key", "rows"), ends, "root", "n", total[0]).drop("root")
    known = join_hubs(named.select("doc_id", "key"), written(of_text, "minhash-classes"), "key", "rows", total[1] or 0)
    none = F.lit(None)
    return known.select("doc_id", "key", "class_id", "class_key").unionByName(rows.filter("doc_id is null").select("doc_id", "key", none.cast("long").alias("class_id"), none.cast("string").alias("class_key")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), kept: one row per document."""
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key"))
    return classes(docs).select("doc_id", "class_id", F.coalesce(stays, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; of repeated rows one stays."""
    stay = classes(docs).filter("doc_id = class_id and key = class_key").groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__md5")).agg(F.count(F.lit(1)).alias("__rows"))
    stay = written(stay, "minhash-kept")
    held = docs.select(F.struct(*quoted(docs)).alias("__doc"), F.col("doc_id").cast("long").alias("__id"), F.md5(F.coalesce("text", F.lit(""))).alias("__md5"))
    found = held.join(stay.hint("shuffle_hash"), ["__id", "__md5"])
    single, repeated = found.filter("__rows = 1"), found.filter("__rows > 1").dropDuplicates(["__id", "__md5"])
    unnamed = held.filter("__id is null")
    return single.select("__doc.*").unionByName(repeated.select("__doc.*")).unionByName(unnamed.select("__doc.*"))
