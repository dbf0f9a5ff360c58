"""Operator 2, language-model scores from Brown class n-grams.

Training tokens are the ASCII lower-case words of every training document and an end after
each.  Their counts are gathered over all training documents and stay a distributed table.

Classes.  The ``ITEMS`` most frequent words are the seeds; each in turn moves to the class in which
the likelihood of the class bigrams is greatest, until a sweep moves none or ``SWEEPS`` are done.
There all other words stand together by ``ENDINGS`` items, a hash of their last three bytes, and
the end is an item (at most (ITEMS + ENDINGS + 1) squared counts go to the driver).  Then every
other word seen at least ``LEAST`` times, a set that grows with the corpus, moves from the class of
its ending to the class in which the likelihood is greatest on its own counts of neighbouring
classes, which are a distributed table.  Words seen less often have too few neighbours to tell
classes by: they keep the class of their ending, as words that were never seen do.  Transitions
are counted over all training tokens with the classes that resulted; there the words outside the
``COMMON`` most frequent ones count by their ending.

Scores.  P(w | before) = P(class | class before) * P(w | class).  Transitions are smoothed with
``BACKOFF`` counts of the class unigram, emissions with ``ADD`` for each word of the class and
one unseen word.  A text begins after an end.  Logarithms are decimal.

Texts are split twice: for the counts of words, and to be written as codes, by the rank of the most
frequent words, ``COMMON`` at most, beside the words that are not among them.  All later passes read
codes.  Counts and classes of the frequent words travel to the executors as arrays; all other words
are joined to the table of words, so every count and class is exact.

Rows: null is the empty text, which is one end.  Rows with a null doc_id are held out or not by
the empty string.  Repeated rows are rows of their own (and train as often); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import written

ITEMS, ENDINGS, CLASSES, SWEEPS = 1000, 500, 48, 8
COMMON = 200_000
#: Words seen this often move on their own.
LEAST = 3
BACKOFF, ADD = 20.0, 0.2
#: Distinct words a task counts before it hands them on.
HELD = 400_000
#: Tokens whose pairs a task counts before it hands them on.
LINE = 2_000_000
END = ITEMS + ENDINGS  # the item of the end of a text; ITEMS + h are the endings
#: Codes of a coded text: 0 is the end, 1 + h a word outside the common ones whose ending is h, FIRST + r the common word of rank r.
FIRST = 1 + ENDINGS


def tokens(text: str | None) -> list[bytes]:
    """Words in ASCII lower case (bytes split at ASCII white space only)."""
    return (text or "").encode().lower().split()


def last_bytes(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def ending(word: bytes) -> int:
    return ITEMS + last_bytes(word)


def held_out(doc_id):
    """remainder 2 of the CRC-32 of the id's digits by 7."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def word_counts(train: DataFrame) -> DataFrame:
    """word binary, n: over all training documents, without the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.update(tokens(text.as_py()))
                if len(found) > HELD:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, n) of the most frequent words, ``most`` at most; words of one count are in or out together.

    A histogram of the counts tells the least count, so no task sorts more than it returns.
    """
    bins = counts.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("k")).collect()  # some thousand rows
    seen, least = 0, None
    for r in sorted(bins, key=lambda r: -r.bin):
        seen += r.k
        if seen > most:
            break
        least = r.bin
    if least is None:  # the commonest bin alone is too large
        return []
    found = counts.filter(F.floor(F.log2("n") * 64) >= least).select("word", "n").toArrow()  # ``most`` rows at most
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))


def coded(docs: DataFrame, common) -> DataFrame:
    """doc_id, held_out, codes (32-bit, little endian, the end last) and the words that are not common, in order: what later passes read instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {w: FIRST + r for r, w in enumerate(common.value)}.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lines, rare = [], []
                for text in part.column(2):
                    words = tokens(text.as_py())
                    line = [code(w) or 1 + last_bytes(w) for w in words]
                    rare.append([w for w, c in zip(words, line) if c < FIRST])
                    line.append(0)
                    lines.append(np.array(line, "<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lines, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["doc_id", "held_out", "codes", "rare"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, codes binary, rare array<binary>")


def _label_pairs(train: DataFrame, labels, size: int) -> np.ndarray:
    """Counts of neighbouring labels over all training tokens of coded texts; ``labels`` has the label of each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = labels.value
        total, held, n = np.zeros(size * size, np.int64), [], 0

        def add():
            x = of[np.concatenate([[0], np.frombuffer(b"".join(held), "<i4")])]  # the end stands before the first text
            at, n = np.unique(x[:-1] * size + x[1:], return_counts=True)
            total[at] += n
            held.clear()

        for batch in batches:
            for codes in batch.column(0):
                held.append(codes.as_py())
                n += len(held[-1]) // 4
                if n > LINE:
                    add()
                    n = 0
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    found = train.select("codes").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # size * size rows at most
    pairs = np.zeros((size, size))
    pairs[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return pairs


def neighbours(train: DataFrame, wanted: DataFrame, common, labels, seeds: int) -> DataFrame:
    """word, codes, ns: how often each class stands after the words wanted (code = class), before them (CLASSES + 1 more), and the word itself after them (the code after those).

    ``train`` are coded texts, ``common`` the common words by rank, ``labels`` has the class of each code; the first ``seeds`` words have no entries.
    """
    k = CLASSES + 1
    width = 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = common.value, labels.value
        held, rare, n = [], [], 0

        def rows():
            line = np.concatenate([[0], np.frombuffer(b"".join(held), "<i4")])
            x = of[line]
            seen: dict[bytes, int] = {}
            who = np.where(line >= FIRST + seeds, line - FIRST, -1)
            who[(line > 0) & (line < FIRST)] = [seen.setdefault(w, len(words) + len(seen)) for w in rare]
            at = np.flatnonzero(who >= 0)
            w = who[at]
            same = w[w == who[at + 1]]
            cells, ns = np.unique(np.concatenate([w * width + x[at + 1], w * width + k + x[at - 1], same * width + 2 * k]), return_counts=True)
            others = list(seen)
            ids, starts = np.unique(cells // width, return_index=True)
            starts = np.append(starts, len(cells))
            for first in range(0, len(ids), 50_000):
                last = min(first + 50_000, len(ids))
                a, b = starts[first], starts[last]
                lists = pa.array((starts[first : last + 1] - a).astype(np.int32))
                named = pa.array([words[i] if i < len(words) else others[i - len(words)] for i in ids[first:last].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([named, pa.ListArray.from_arrays(lists, pa.array((cells[a:b] % width).astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(ns[a:b]))], names=["word", "codes", "ns"])
            held.clear()
            rare.clear()

        for batch in batches:
            for codes, more in zip(batch.column(0), batch.column(1)):
                held.append(codes.as_py())
                rare.extend(more.as_py())
                n += len(held[-1]) // 4
                if n > LINE or len(rare) > HELD:
                    yield from rows()
                    n = 0
        if held:
            yield from rows()

    found = train.select("codes", "rare").mapInArrow(run, "word binary, codes array<int>, ns array<long>").join(wanted.select("word"), "word")
    cells = found.select("word", F.explode(F.arrays_zip("codes", "ns")).alias("x")).groupBy("word", F.col("x.codes").alias("code")).agg(F.sum("x.ns").alias("n"))
    return cells.groupBy("word").agg(F.collect_list("code").alias("codes"), F.collect_list("n").alias("ns"))


def gains(between: np.ndarray, of: np.ndarray, start: np.ndarray, codes: np.ndarray, ns: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By word and class: the likelihood with the word in the class, less that without the word.

    ``codes`` and ``ns`` have the entries of word i, as ``neighbours`` gives them, from ``start[i]`` on.
    """
    k, m = len(between), len(of)
    at = np.repeat(np.arange(m), np.diff(start))
    a, j = of[at], codes % k
    after = codes < k
    right, left = np.zeros((m, k)), np.zeros((m, k))
    right[at[after], j[after]] = ns[after]
    left[at[~after], j[~after]] = ns[~after]
    every = np.arange(m)
    right[every, of] -= own
    left[every, of] -= own
    ns = np.where(j == a, ns - own[at], ns)
    table = np.concatenate([between.T, between])  # by code: the cell of class c that an entry goes to
    value = _xlogx(table)
    base = table[codes]
    change = np.empty_like(base)
    low = ns <= 8
    if low.any():  # most words are rare: their terms are looked up
        steps = np.stack([_xlogx(table + n) - value for n in range(9)])
        change[low] = steps[ns[low].astype(np.int64), codes[low]]
    if not low.all():
        change[~low] = _xlogx(base[~low] + ns[~low, None]) - value[codes[~low]]
    # Without the word: its row and column leave its own class.
    entry = np.arange(len(codes))
    base[entry, a] -= ns
    inner = np.flatnonzero(j == a)
    base[inner] -= np.where(after[inner, None], left[at[inner]], right[at[inner]])
    base[inner, a[inner]] -= own[at[inner]]
    change[inner] = _xlogx(base[inner] + ns[inner, None]) - _xlogx(base[inner])
    change[entry, a] = _xlogx(base[entry, a] + ns) - _xlogx(base[entry, a])
    gain = np.add.reduceat(change, start[:-1], axis=0)
    corner = np.tile(np.diag(between), (m, 1))
    corner[every, of] -= right[every, of] + left[every, of] + own
    gain += _xlogx(corner + right + left + own[:, None]) - _xlogx(corner + right) - _xlogx(corner + left) + _xlogx(corner)
    for total, part in ((between.sum(1), right), (between.sum(0), left)):
        moved = (part.sum(1) + own)[:, None]
        rest = np.tile(total, (m, 1))
        rest[every, of] -= moved[:, 0]
        gain -= _xlogx(rest + moved) - _xlogx(rest)
    gain[:, k - 1] = -np.inf  # the end is alone
    return gain


def moved(near: DataFrame, between: np.ndarray, of_endings: np.ndarray) -> DataFrame:
    """word, class: where the likelihood is greatest with the word moved there from the class of its ending."""
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                of = of_endings[[last_bytes(w) for w in part.column(0).to_pylist()]]
                codes, ns = (part.column(c).flatten().to_numpy() for c in (1, 2))
                row = np.repeat(np.arange(len(of)), part.column(1).value_lengths().to_numpy())
                self_ = codes == 2 * k
                own = np.bincount(row[self_], ns[self_], len(of))
                start = np.concatenate([[0], np.cumsum(np.bincount(row[~self_], minlength=len(of)))])
                gain = gains(between, of, start, codes[~self_].astype(np.int64), ns[~self_].astype(np.float64), own)
                best, every = gain.argmax(1), np.arange(len(of))
                best = np.where(gain[every, best] > gain[every, of] + 1e-6, best, of)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32))], names=["word", "class"])

    return near.mapInArrow(run, "word binary, class int")


def _classed(counts: DataFrame, seeds: dict[bytes, int], of_endings: np.ndarray) -> DataFrame:
    """word, n, class: the class given, or the seed's, or that of the ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c if c is not None else seeds[w] if w in seeds else int(of_endings[last_bytes(w)]) for w, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["word", "n", "class"])

    return counts.select("word", "n", "class").mapInArrow(run, "word binary, n long, class int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item by exchange clustering on item bigram counts; the last item, the end, keeps a class of its own."""
    n = len(pairs)
    total = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-total[:-1], kind="stable")
    of = np.full(n, classes, np.int64)
    of[order] = np.arange(n - 1) % classes
    k = classes + 1
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    right, left = pairs @ member, pairs.T @ member  # by item: counts of following and of preceding classes
    between = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not total[w]:
                continue
            a, self_ = of[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            # Without w: its row and column leave class a.
            r[a] -= self_
            l[a] -= self_
            base = between.copy()
            base[a] -= r
            base[:, a] -= l
            base[a, a] -= self_
            rows, columns = base.sum(1), base.sum(0)
            # Adding w to class c changes row c by r, column c by l, and the corner by both and w's own pairs.
            gain = (_xlogx(base + r[None, :]) - _xlogx(base)).sum(1) + (_xlogx(base + l[:, None]) - _xlogx(base)).sum(0)
            corner = np.diag(base)
            gain += _xlogx(corner + r + l + self_) - _xlogx(corner + r) - _xlogx(corner + l) + _xlogx(corner)
            out, into = r.sum() + self_, l.sum() + self_
            # Class totals change in row c (as first), column c (as second), and for the classes around by the same amounts wherever w goes.
            rest_rows, rest_columns = rows + l, columns + r
            gain -= _xlogx(rest_rows + out) - _xlogx(rest_rows) + _xlogx(rest_columns + into) - _xlogx(rest_columns)
            gain[classes] = -np.inf
            c = int(np.argmax(gain))
            if gain[c] <= gain[a] + 1e-9:
                continue
            of[w] = c
            moved += 1
            base[c] += r
            base[:, c] += l
            base[c, c] += self_
            between = base
            right[:, a] -= pairs[:, w]
            right[:, c] += pairs[:, w]
            left[:, a] -= pairs[w]
            left[:, c] += pairs[w]
        if not moved:
            break
    return of


def likelihood(pairs: np.ndarray, of: np.ndarray) -> float:
    """Class part of the log-likelihood that exchange raises."""
    k = of.max() + 1
    member = np.zeros((len(pairs), k))
    member[np.arange(len(pairs)), of] = 1
    between = member.T @ pairs @ member
    return float(_xlogx(between).sum() - _xlogx(between.sum(1)).sum() - _xlogx(between.sum(0)).sum())


@dataclass
class Model:
    """What scoring needs besides the table of counts; its size does not depend on the corpus."""

    classes: np.ndarray  # of items; those of the endings hold for words that were never seen
    transition: np.ndarray  # log10
    emission_total: np.ndarray  # log10 of each class's denominator
    common_n: np.ndarray  # of the common words by rank, as the next
    common_class: np.ndarray
    n_tokens: int
    n_distinct: int
    n_ends: int


def fit(train: DataFrame) -> tuple[DataFrame, Model]:
    """Table of words (word, n, class) and the model."""
    return _fitted(train.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"))[:2]


def _fitted(docs: DataFrame) -> tuple[DataFrame, Model, DataFrame]:
    """Table of words and model, learned from what is not held out, and all coded texts."""
    context = docs.sparkSession.sparkContext
    counts = written(word_counts(docs.filter("not held_out")), "brown-words")
    common = frequent(counts, COMMON)
    words = context.broadcast([w for w, _ in common])  # COMMON at most
    every = written(coded(docs, words), "brown-coded")
    train = every.filter("not held_out")
    n_ends = train.count()
    n_seeds = min(ITEMS, len(common))
    rank = {w: r for r, (w, _) in enumerate(common)}
    of_common = np.array([last_bytes(w) for w, _ in common], np.int64)  # their endings

    def by_code(end: int, endings: np.ndarray, of_ranks: np.ndarray):
        return context.broadcast(np.concatenate([[end], endings, of_ranks]).astype(np.int64))

    items = np.concatenate([np.arange(n_seeds), ITEMS + of_common[n_seeds:]])
    pairs = _label_pairs(train, by_code(END, np.arange(ITEMS, END), items), END + 1)
    of = exchange(pairs, CLASSES, SWEEPS)
    member = np.eye(CLASSES + 1)[of]
    of_endings = of[ITEMS:END]
    seeds = {w: int(of[k]) for k, (w, _) in enumerate(common[:n_seeds])}
    near = written(neighbours(train, counts.filter(F.col("n") >= LEAST), words, by_code(CLASSES, of_endings, of[items]), n_seeds), "brown-neighbours")
    after = moved(near, member.T @ pairs @ member, of_endings)
    counts = written(_classed(counts.join(after, "word", "left"), seeds, of_endings), "brown-words-classed")
    least = common[-1][1] if common else math.inf
    in_common = counts.filter(F.col("n") >= least).select("word", "class").toArrow()  # COMMON rows at most
    common_class = np.zeros(len(common), np.int64)
    common_class[[rank[w] for w in in_common.column("word").to_pylist()]] = in_common.column("class").to_numpy()
    between = _label_pairs(train, by_code(CLASSES, of_endings, common_class), CLASSES + 1)
    n_class, distinct_class = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    totals = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()  # one row per class
    for r in totals:
        n_class[r["class"]], distinct_class[r["class"]] = r.n, r.distinct
    n_class[CLASSES] = n_ends
    unigram = (between.sum(0) + 1) / (between.sum() + CLASSES + 1)
    transition = np.log10((between + BACKOFF * unigram) / (between.sum(1) + BACKOFF)[:, None])
    emission_total = np.log10(n_class + ADD * (distinct_class + 1))
    emission_total[CLASSES] = 0.0  # the end is all of its class
    n_words, n_distinct = sum(r["n"] for r in totals), sum(r["distinct"] for r in totals)
    model = Model(of, transition, emission_total, np.array([n for _, n in common], np.float64), common_class, n_words + n_ends, n_distinct + (n_ends > 0), n_ends)
    return counts, model, every


def _partly_scored(every: DataFrame, model) -> DataFrame:
    """Scores of coded texts without the words outside the common ones, which come along (``rare``, ``places``) with the classes of the text (``line``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        end = len(m.transition) - 1
        of = np.concatenate([[end], m.classes[-1 - ENDINGS : -1], m.common_class])  # by code
        base_end = np.log10((m.n_ends + 1) / (m.n_tokens + m.n_distinct + 1))
        base_total = np.log10(m.n_tokens + m.n_distinct + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for codes in part.column(2):
                    x = np.frombuffer(codes.as_py(), "<i4")
                    places = np.flatnonzero((x > 0) & (x < FIRST))
                    line = np.concatenate([[end], of[x]])
                    n = m.common_n[x[x >= FIRST] - FIRST]
                    # A text with rare words waits for their classes.
                    score = np.log10(n + ADD).sum() + (0.0 if len(places) else _line_score(m, line))
                    base = np.log10(n + 1).sum() - (len(x) - 1) * base_total + base_end
                    rows.append((len(x), len(n) + (m.n_ends > 0), float(base), float(score), places.astype(np.int32), line.astype(np.uint8).tobytes() if len(places) else None))
                *numbers, places, lines = zip(*rows)
                columns = [pa.array(c, t) for c, t in zip(numbers, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, part.column(3), pa.array(places, pa.list_(pa.int32())), pa.array(lines, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "places", "line"])

    given = every.select("doc_id", "held_out", "codes", "rare")
    return given.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>, places array<int>, line binary")


def _line_score(model: Model, line: np.ndarray) -> float:
    return float(model.transition[line[:-1], line[1:]].sum() - model.emission_total[line[1:]].sum())


def _with_lines(rows: DataFrame, model) -> DataFrame:
    """Adds the scores of the lines that waited; ``found`` has the place and class of each rare word that training knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for text, found in zip(batch.column("line").to_pylist(), batch.column("found").to_pylist()):
                line = np.frombuffer(text, np.uint8).astype(np.int64)
                for f in found or ():
                    line[f["place"] + 1] = f["class"]
                more.append(_line_score(model.value, line))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("known"), batch.column("base_more"), pa.array(np.array(more) + batch.column("model_more").to_numpy())], names=["row", "known", "base_more", "model_more"])

    return rows.select("row", "line", "known", "base_more", "model_more", "found").mapInArrow(run, "row long, known long, base_more double, model_more double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row per document."""
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text")
    counts, model, every = _fitted(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers of COMMON words at most
    partly = written(_partly_scored(every, shared).withColumn("row", F.monotonically_increasing_id()), "brown-partly")
    rare = partly.select("row", F.explode(F.arrays_zip("rare", "places")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.places").alias("place"))
    # A word that is not in the table was never seen; n + 1 and n + ADD are then 1 and ADD.
    n = F.coalesce("n", F.lit(0)).cast("double")
    sums = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.count("n").alias("known"), F.sum(F.log10(n + 1)).alias("base_more"), F.sum(F.log10(n + ADD)).alias("model_more"), F.collect_list(F.when(F.col("n").isNotNull(), F.struct("place", "class"))).alias("found"))
    )
    sums = _with_lines(sums.join(partly.filter("line is not null").select("row", "line"), "row"), shared)
    out = partly.drop("rare", "places", "line").join(sums, "row", "left")
    more = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.col("model") + more("model_more")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("base_more")).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
