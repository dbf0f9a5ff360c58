"""Operator 11, phrase collocations by pivot partitioning, as in MG-FSM.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``.  A phrase is a run of one to LONGEST words of a piece; its pivot is its rarest
word, of equally rare ones the leftmost.  For every word occurrence one fragment is routed to that
word: the words around it, as far as a phrase can reach, cut on the left at the first word that is not
more frequent and on the right at the first word that is rarer.  So each occurrence of a phrase lies in exactly one
fragment around its pivot.  Equal fragments of a block are counted before they are sent.  Each
pivot's fragments are mined by themselves, and only phrases that hold the pivot are counted.

How rare a word is comes from counts in 2^20 buckets by hash, a broadcast of 8 MB whatever the
corpus.  A bucket bounds the counts of its words from above, so words of buckets below the least count are in
no phrase that is wanted; which word is the pivot changes where a phrase is counted, never its count.

A pivot of over PART occurrences is dealt out by fragment to several groups, and a group of over
ENTRIES fragments is mined piece by piece; the sums of such phrases are made by one more grouping.  All other
groups are complete by themselves and pass on frequent phrases only; many of them are mined at once, with arrays.

Rows: null and empty texts have no words; a null language is ``und``; repeated rows count each;
an empty table gives no rows; other columns are ignored.  A text of any length is read in blocks
that overlap by as many words as a phrase can reach; a word of any length is one word.  Ties are broken by
count, then by the phrase's bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.common import written

LONGEST = 4
LEAST = 30
BUCKETS = 1 << 20
#: Bytes of text that are hashed at once.
BLOCK = 4_000_000
#: Occurrences of a pivot that one group may have, and fragments that are mined at once; also by their bytes.
PART, ENTRIES, HELD = 100_000, 300_000, 64_000_000
#: Groups in which each language's best phrases are found first.
CELLS = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_BORDER = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")

#: Words of up to so many bytes are hashed by a sum of bytes times random factors, longer ones by a digest.
_SHORT = 64
_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(1, 1 << 63, (2, _SHORT), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, (2, 2 * 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _digests(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of a block: begins, ends, number of the piece, and two hashes of 64 bits."""

    def __init__(self, block: bytes, lang: str):
        b = np.frombuffer(block, np.uint8)
        kind = _KIND[b]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.begin)
        self.length = self.end - self.begin
        self.h = np.zeros((2, len(self.begin)), np.uint64)
        if not len(self.begin):
            return
        first = np.cumsum(self.length) - self.length
        place = np.arange(int(self.length.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), self.length)
        np.minimum(place, _SHORT - 1, out=place)
        value = b[inside].astype(np.uint64) + np.uint64(1)
        salt = _digests(lang.encode())
        for k in (0, 1):
            self.h[k] = _mixed(np.add.reduceat(value * _FACTORS[k][place], first) ^ np.uint64(salt[k]))
        for i in np.flatnonzero(self.length > _SHORT).tolist():
            for k, d in enumerate(_digests(lang.encode() + b"\n" + block[self.begin[i] : self.end[i]])):
                self.h[k, i] = d

    def buckets(self) -> np.ndarray:
        return (self.h[0] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _back(text: bytes, at: int, words: int) -> int:
    """Where a stretch begins that ends at ``at`` and holds so many whole words, or the text's begin."""
    reach = 256
    while True:
        low = max(0, at - reach)
        found = [m.start() + low for m in _WORD.finditer(text[low:at])]
        if low == 0 and len(found) <= words:
            return 0
        if len(found) > words:  # the first may be cut off
            return found[-words]
        reach *= 4


def _ahead(text: bytes, at: int, words: int) -> int:
    for _ in range(words):
        m = _WORD.search(text, at)
        if not m:
            return len(text)
        at = m.end()
    return at


def blocks(texts: list[bytes], block: int, around: int) -> Iterator[tuple[bytes, int, int]]:
    """(stretch, low, high): words that begin in [low, high) are the stretch's own, others stand around.

    Every word is one stretch's own.  Short texts share a stretch, with a border between them.
    """
    some, size = [], 0
    for text in texts:
        if size and size + len(text) > block:
            yield (joined := b"\n".join(some)), 0, len(joined)
            some, size = [], 0
        if len(text) <= block:
            some.append(text)
            size += len(text) + 1
            continue
        at = 0
        while at < len(text):
            m = _BORDER.search(text, min(at + block, len(text)))
            to = m.start() if m else len(text)
            low, high = _back(text, at, around), _ahead(text, to, around)
            yield text[low:high], at - low, to - low
            at = to
    if some:
        yield (joined := b"\n".join(some)), 0, len(joined)


def _by_lang(batch: pa.RecordBatch, block: int) -> Iterator[tuple[str, list[bytes]]]:
    """Lower-cased texts by language, some ``block`` bytes at a time, so that a batch of long texts is not held twice."""
    found, size = defaultdict(list), 0
    for lang, text in zip(batch.column(0), batch.column(1)):
        text = text.as_py()
        if text:
            found[lang.as_py()].append(text.lower().replace(b"\t", b" "))
            size += len(text)
        if size >= block:
            yield from found.items()
            found, size = defaultdict(list), 0
    yield from found.items()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_buckets(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, bucket, n: words by bucket (lang null), and all words by language (bucket null)."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(BUCKETS, np.int64), defaultdict(int)
        for batch in batches:
            for lang, texts in _by_lang(batch, block):
                for stretch, low, high in blocks(texts, block, 0):
                    words = Words(stretch, lang)
                    own = (words.begin >= low) & (words.begin < high)
                    total[lang] += int(own.sum())
                    counts += np.bincount(words.buckets()[own], minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.array(used), pa.array(counts[used])], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], schema=schema)

    return _texts(docs).mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _fragments(stretch: bytes, low: int, high: int, lang: str, bound: np.ndarray, longest: int, part: int) -> pa.RecordBatch | None:
    """Distinct fragments of a stretch's own words with their numbers, and the group that each goes to."""
    words = Words(stretch, lang)
    n, reach = len(words.begin), longest - 1
    rate = bound[words.buckets()]
    rates, pieces = np.pad(rate, reach), np.pad(words.piece, reach, constant_values=-1)
    hashes = [np.pad(h, reach) for h in words.h]
    own = np.flatnonzero((rate > 0) & (words.begin >= low) & (words.begin < high))
    if not len(own):
        return None
    mine, piece = rate[own], words.piece[own]
    total = [h[own] * _PLACES[k][reach] for k, h in enumerate(words.h)]
    extent = []
    for side in (-1, 1):
        open_, many = np.ones(len(own), bool), np.zeros(len(own), np.int64)
        for step in range(1, reach + 1):
            at = own + reach + side * step
            open_ &= (pieces[at] == piece) & ((rates[at] > mine) if side < 0 else (rates[at] >= mine))
            many += open_
            for k in (0, 1):
                total[k] += np.where(open_, hashes[k][at] * _PLACES[k][reach + side * step], np.uint64(0))
        extent.append(many)
    order = np.argsort(total[0])  # of 128 bits that are equal; should a run be interleaved, a fragment is two rows
    t0, t1 = total[0][order], total[1][order]
    heads = np.flatnonzero(np.concatenate([[True], (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])]))
    count = np.diff(np.append(heads, len(order)))
    pick = order[heads]
    i, before, after = own[pick], extent[0][pick], extent[1][pick]
    begin, end = words.begin[i - before], words.end[i + after]
    upto = np.concatenate([[0], np.cumsum(words.length)])
    plain = (end - begin) == upto[i + after + 1] - upto[i - before] + before + after
    text = [stretch[b:e] for b, e in zip(begin.tolist(), end.tolist())]
    for k in np.flatnonzero(~plain).tolist():
        text[k] = b" ".join(text[k].split())
    parts = 1 + (rate[i] // part).astype(np.uint64)
    group = _mixed(words.h[0][i] + (_mixed(total[1][pick]) % parts) * np.uint64(0xD1B54A32D192ED03))
    return pa.RecordBatch.from_arrays(
        [pa.array(group.view(np.int64)), pa.array([lang] * len(i), pa.string()), pa.array(text, pa.binary()), pa.array(before.astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(parts > 1)],
        names=["key", "lang", "fragment", "place", "n", "dealt"],
    )


def fragments(docs: DataFrame, bound: np.ndarray, longest: int = LONGEST, part: int = PART, block: int = BLOCK) -> DataFrame:
    """key (of the pivot), lang, fragment, place (of the pivot in it), n, dealt (the pivot has several keys)."""
    shared = docs.sparkSession.sparkContext.broadcast(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch, block):
                for stretch, low, high in blocks(texts, block, longest - 1):
                    found = _fragments(stretch, low, high, lang, shared.value, longest, part)
                    for at in range(0, found.num_rows if found else 0, 50_000):
                        yield found.slice(at, 50_000)

    return _texts(docs).mapInArrow(run, "key long, lang string, fragment binary, place int, n long, dealt boolean")


def _alike(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the number of its key, for each key the sum of ``n`` and one of its rows."""
    order = np.argsort(key)
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    return number, np.add.reduceat(n[order], heads), order[heads]


def _phrases(lang: pa.Array, fragment: pa.Array, place: np.ndarray, n: np.ndarray, whole: np.ndarray, longest: int, least: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(rows that hold them, phrases, numbers) of the pivots' phrases: all of rows that are not ``whole``, frequent ones of the others.

    Phrases grow by one word at a time, on the left or on the right of the pivot.  Numbers stand for words and for shorter phrases, so
    equal numbers are equal words.  Where all of a pivot's fragments are at hand, a phrase is counted only if what it grew from is frequent.
    """
    rows = len(place)
    offsets = np.frombuffer(fragment.buffers()[1], np.int32, rows + 1, 4 * fragment.offset).astype(np.int64)
    raw = fragment.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    data = np.frombuffer(raw, np.uint8)
    gap = data == 0x20
    gaps = np.flatnonzero(gap)
    before_row = np.searchsorted(gaps, offsets)  # gaps before each fragment
    row_of_gap = np.repeat(np.arange(rows), np.diff(before_row))
    first = np.arange(rows + 1) + before_row  # each fragment's first word
    begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    begin[first[:-1]], end[first[1:] - 1] = offsets[:-1], offsets[1:]
    begin[row_of_gap + np.arange(len(gaps)) + 1], end[row_of_gap + np.arange(len(gaps))] = gaps + 1, gaps
    ends = np.cumsum(end - begin, dtype=np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.concatenate([[np.int32(0)], ends]).astype(np.int32)), pa.py_buffer(data[~gap])])
    word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    base, pivot = int(word.max()) + 1, first[:-1] + place
    before, after = place, np.diff(first) - place - 1
    found: dict[tuple[int, int], np.ndarray] = {}
    for size in range(longest):
        shorter, found = found, {}
        for left in range(size + 1):
            right = size - left
            if not size:
                at, key = np.arange(rows), lang.dictionary_encode().indices.to_numpy().astype(np.int64) * base + word[pivot]
            else:
                can = (before >= left) & (after >= right)
                if left:
                    can &= shorter[left - 1, right] >= 0
                if right:
                    can &= shorter[left, right - 1] >= 0
                at = np.flatnonzero(can)
                key = (shorter[left - 1, right][at] * base + word[pivot[at] - left]) if left else (shorter[left, right - 1][at] * base + word[pivot[at] + right])
            known = found[left, right] = np.full(rows, -1, np.int64)
            if not len(at):
                continue
            number, total, one = _alike(key, n[at])
            one = at[one]
            kept = ~whole[one] | (total >= least)
            known[at] = np.where(kept[number], number, -1)
            one = one[kept]
            yield one, [raw[b:e] for b, e in zip(begin[pivot[one] - left].tolist(), end[pivot[one] + right].tolist())], total[kept]


def mined(routed: DataFrame, longest: int = LONGEST, least: int = LEAST, entries: int = ENTRIES) -> DataFrame:
    """lang, phrase, n, whole: phrases owned by the pivot of each key; n is all of it where ``whole``, a summand elsewhere."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64()), ("whole", pa.bool_())])

    def made(table: pa.Table, broken: int | None) -> Iterator[pa.RecordBatch]:
        key, lang, fragment, place, n, dealt = (table.column(k).combine_chunks() for k in range(6))
        lang, fragment = lang.cast(pa.string()), fragment.cast(pa.binary())
        whole = ~dealt.to_numpy(zero_copy_only=False)
        if broken is not None:
            whole &= key.to_numpy() != broken
        for rows, phrases, total in _phrases(lang, fragment, place.to_numpy().astype(np.int64), n.to_numpy(), whole, longest, least):
            for at in range(0, len(rows), 50_000):
                some = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(rows[some])), pa.array(phrases[some], pa.binary()), pa.array(total[some]), pa.array(whole[rows[some]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, room, broken = 0, 0, None
        for batch in (b.slice(at, entries) for b in batches for at in range(0, b.num_rows, entries)):
            held.append(batch)
            size, room = size + batch.num_rows, room + batch.nbytes
            if size < entries and room < HELD:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_numpy()
            last = int(keys[-1])
            cut = int(np.searchsorted(keys, last))
            if cut:  # all rows of the keys before the last are there
                yield from made(table.slice(0, cut), broken)
                held = table.slice(cut).to_batches()
            else:  # more of one key than is held
                yield from made(table, last)
                broken, held = last, []
            size, room = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
        if held:
            yield from made(pa.Table.from_batches(held), broken)

    return routed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "lang string, phrase binary, n long, whole boolean")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, part: int = PART, entries: int = ENTRIES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of 1 to ``longest`` words found ``least`` times or more, and (lang, n) of all words; both written."""
    counted = written(word_buckets(docs, block), "word-buckets")
    bound = np.zeros(BUCKETS, np.int64)
    frequent = counted.filter(F.col("bucket").isNotNull() & (F.col("n") >= least)).select("bucket", "n").toArrow()  # BUCKETS rows at most
    bound[frequent["bucket"].to_numpy()] = frequent["n"].to_numpy()
    found = written(mined(fragments(docs, bound, longest, part, block), longest, least, entries), "phrases")
    rest = found.filter("not whole").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    phrases = found.filter("whole").select("lang", "phrase", "n").unionByName(rest).select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
    phrases = phrases.withColumn("k", F.size(F.split("phrase", " ")))
    return written(phrases, "phrase-counts"), counted.filter("bucket is null").select("lang", "n")


def collocations(docs: DataFrame, top: int = 2000, longest: int = LONGEST, least: int = LEAST, part: int = PART, entries: int = ENTRIES, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to ``longest`` words.

    score is the least floor(2000000 a / (l + r)) over the cuts of a phrase.  Phrases that a longer one
    covers to 80 % are dropped.  Products are decimals of 38 digits.
    """
    phrases, totals = phrase_counts(docs, longest, least, part, entries, block)
    candidates = phrases.filter("k > 1").withColumn("w", F.split("phrase", " "))
    part_of = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    cuts = candidates.select("lang", "phrase", "n", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = cuts.select("lang", "phrase", "n", "cut", F.explode(F.array(F.struct(F.lit(True).alias("first"), part_of(F.lit(1), F.col("cut")).alias("side")), F.struct(F.lit(False).alias("first"), part_of(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("side")))).alias("s"))
    asked = sides.select("lang", "phrase", F.col("n").alias("a"), "cut", "s.first", F.col("s.side").alias("side"))
    known = phrases.select("lang", F.col("phrase").alias("side"), F.col("n").alias("f"))
    pairs = asked.join(known, ["lang", "side"]).groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = pairs.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("s")).groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))
    # Every longer candidate names the phrases inside it.
    starts = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda b: F.struct(b.alias("b"), m.alias("m"))))))
    inner = candidates.filter("k > 2").select("lang", "n", "w", starts.alias("i")).select("lang", part_of(F.col("i.b"), F.col("i.m")).alias("phrase"), "n")
    covered = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = scored.join(covered, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 80 * a").select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    cell = F.pmod(F.xxhash64("phrase"), F.lit(CELLS))
    some = left.withColumn("place", F.row_number().over(Window.partitionBy("lang", cell).orderBy(*best))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
begun as (select lang, w, unnest(range(1, len(w) + 1)) as b from worded),
sized as (select lang, w, b, unnest(range(1, least(4, len(w) - b + 1) + 1)) as k from begun),
counted as (
  select lang, k, w[b : b + k - 1] as v, count(*) as a from sized group by all having count(*) >= 30),
cuts as (select lang, v, k, a, unnest(range(1, k)) as cut from counted where k > 1),
scored as (
  select c.lang, c.v, c.a, c.cut, f.a as l, g.a as r, ((2000000::hugeint * c.a) // (f.a + g.a))::bigint as score
  from cuts c join counted f on f.lang = c.lang and f.v = c.v[1 : c.cut]
    join counted g on g.lang = c.lang and g.v = c.v[c.cut + 1 : c.k]),
lowest as (select * from scored qualify row_number() over (partition by lang, v order by score, cut) = 1),
sizes as (select lang, v, k, a, unnest(range(2, k)) as m from counted where k > 2),
starts as (select lang, v, a, m, unnest(range(1, k - m + 2)) as b from sizes),
covered as (select lang, v[b : b + m - 1] as v, max(a) as longer from starts group by all),
remain as (
  select s.lang, array_to_string(s.v, ' ') as phrase, s.a, s.l, s.r, s.score
  from lowest s left join covered o on o.lang = s.lang and o.v = s.v
  where o.longer is null or 100 * o.longer < 80 * s.a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score
from remain join totals using (lang)
qualify rank <= 2000
"""
