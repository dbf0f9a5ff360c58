"""Fitted topics over all documents: posterior weights by variational inference, and c_v coherence of topics' words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions.expr import digamma
from revlake.functions.text import clean_ascii, tokens
from revlake.operators.topics import spread

#: Weights (terms times topics) that are broadcast; beyond that terms are joined to the documents.
BROADCAST_WEIGHTS = 20_000_000
#: Rounds of inference, and the mean change of a document's parameters that ends them.
ITERATIONS, CHANGE = 100, 1e-3
#: Words of a window of c_v, and what keeps its logarithms finite.
WINDOW, EPSILON = 110, 1e-12
#: Windows of a text that are looked at together.
WINDOWS = 16_384


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    out = np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    for k in range(6):
        out = out - 1 / (x + k)
    return out


def infer(begin: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: np.ndarray, iterations: int, change: float) -> np.ndarray:
    """Topic weights of documents whose terms stand at ``begin[d]:begin[d + 1]`` with numbers ``n`` and rows ``beta`` of exp E[log beta].

    A document stops by itself when its parameters change by less than ``change`` on average, whatever stands beside it.
    """
    size = np.diff(begin)
    gamma = alpha[None, :] + np.repeat((np.add.reduceat(np.append(n, 0.0), np.minimum(begin[:-1], len(n))) * (size > 0))[:, None] / len(alpha), len(alpha), 1)
    gamma[size == 0] = alpha
    live = np.flatnonzero(size > 0)
    for _ in range(iterations):
        if not len(live):
            break
        of = np.repeat(np.arange(len(live)), size[live])
        at = np.repeat(begin[live] - (np.cumsum(size[live]) - size[live]), size[live]) + np.arange(len(of))
        now = gamma[live]
        theta = np.exp(_digamma(now) - _digamma(now.sum(1))[:, None])
        rows = beta[at]
        share = n[at] / ((theta[of] * rows).sum(1) + 1e-100)
        first = np.cumsum(size[live]) - size[live]
        new = alpha + theta * np.add.reduceat(share[:, None] * rows, first, axis=0)
        gamma[live] = new
        live = live[np.abs(new - now).mean(1) >= change]
    return gamma / gamma.sum(1, keepdims=True)


def _as_lists(weights: np.ndarray) -> pa.Array:
    offsets = np.arange(len(weights) + 1, dtype=np.int32) * weights.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(weights.reshape(-1)))


def posterior(texts: DataFrame, key: str, topics: DataFrame, alpha: list[float], iterations: int = ITERATIONS, change: float = CHANGE, limit: int = BROADCAST_WEIGHTS) -> DataFrame:
    """key, weights: what share of each document the topics have, for every document.

    ``texts`` has the key and an array ``words``; ``topics`` has term and weights (the parameters of each topic's distribution of
    words, one number a topic).  A document without a known word has the weights of ``alpha``.
    """
    k, prior = len(alpha), np.array(alpha, float)
    totals = topics.agg(*(F.sum(F.get("weights", F.lit(i))).alias(f"t{i}") for i in range(k)))  # one row
    beta = topics.crossJoin(F.broadcast(totals)).select("term", F.array(*(F.exp(digamma(F.get("weights", F.lit(i))) - digamma(F.col(f"t{i}"))) for i in range(k))).alias("b"))
    if topics.count() * k <= limit:
        table = beta.toArrow().combine_chunks()
        shared = texts.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), table.column("b").combine_chunks().flatten().to_numpy().reshape(-1, k)))

        @F.arrow_udf("array<double>")
        def of_words(words: pa.Array) -> pa.Array:
            terms, rows = shared.value
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            at = pc.index_in(words.flatten(), value_set=terms)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(length)), length)[known].astype(np.int64)
            pair, n = np.unique(doc * len(rows) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            begin = np.searchsorted(pair, np.arange(len(length) + 1) * len(rows))
            return _as_lists(infer(begin, n.astype(float), rows[pair % max(1, len(rows))], prior, iterations, change))

        return texts.select(key, of_words("words").alias("weights"))
    counts = texts.select(key, F.explode("words").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    of_doc = counts.join(beta, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "n", "b"))).alias("x")).select(key, F.col("x.n").alias("n"), F.flatten("x.b").alias("b"))

    @F.arrow_udf("array<double>")
    def of_rows(n: pa.Array, b: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(n), 0).to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        return _as_lists(infer(begin, n.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False).reshape(-1, k), prior, iterations, change))

    return texts.select(key).join(of_doc, key, "left").select(key, of_rows("n", "b").alias("weights"))


def topic_table(vocabulary: list[str], model) -> DataFrame:
    """term, weights of a fitted model, from its matrix of terms by topics: the only table that is as long as the vocabulary."""
    matrix = model.topicsMatrix()
    values = np.array(matrix.toArray()).reshape(matrix.numCols(), matrix.numRows()).T
    return SparkSession.getActiveSession().createDataFrame([(t, [float(x) for x in v]) for t, v in zip(vocabulary, values)], "term string, weights array<double>")


def _windows_of_pairs(place: np.ndarray, term: np.ndarray, windows: int, window: int, sums: np.ndarray) -> None:
    """Adds to ``sums``, terms by terms, the windows of one text that hold both; the terms stand at ``place`` of the text."""
    low, high = np.maximum(place - window + 1, 0), np.minimum(place, windows - 1)
    for begin in range(0, windows, WINDOWS):
        end = min(windows, begin + WINDOWS)
        here = (high >= begin) & (low < end)
        present, column = np.unique(term[here], return_inverse=True)
        if len(present):
            edges = np.zeros((end - begin + 1, len(present)), np.int32)
            np.add.at(edges, (np.maximum(low[here], begin) - begin, column), 1)
            np.add.at(edges, (np.minimum(high[here] + 1, end) - begin, column), -1)
            held = (np.cumsum(edges[:-1], axis=0) > 0).astype(float)
            sums[np.ix_(present, present)] += (held.T @ held).astype(np.int64)


def window_counts(texts: DataFrame, chosen: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(topic, a, b, n) with a <= b: windows that hold both of a topic's ranked words, and one row with the number of all windows.

    ``texts`` has doc_id and words.  A window is ``window`` words in a row, or a shorter text as a whole.  An occurrence at place p lies in windows
    p - window + 1 to p.  Pairs of words are counted once for all topics that have them.
    """
    last = F.greatest(F.size("words") - window, F.lit(0))
    total = texts.filter("size(words) > 0").agg(F.sum((last + 1).cast("long")).alias("n_windows"))
    terms = chosen.select("term").distinct().orderBy("term").toArrow()["term"].combine_chunks()  # some words per topic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(terms), len(terms)), np.int64)
        for batch in batches:
            lists = batch.column(0)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(length)])
            at = pc.index_in(lists.flatten(), value_set=terms)
            places = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            of = at.drop_null().to_numpy().astype(np.int64)
            first = np.searchsorted(places, begin)
            for d in np.flatnonzero(np.diff(first)).tolist():
                some = slice(first[d], first[d + 1])
                _windows_of_pairs(places[some] - begin[d], of[some], max(1, int(length[d]) - window + 1), window, sums)
        x, y = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(x)), terms.take(pa.array(y)), pa.array(sums[x, y])], names=["x", "y", "n"])

    together = texts.select("words").mapInArrow(run, "x string, y string, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    pairs = chosen.select("topic", F.col("rank").alias("a"), F.col("term").alias("x")).join(chosen.select("topic", F.col("rank").alias("b"), F.col("term").alias("y")), "topic").filter("a <= b")
    return pairs.join(together, ["x", "y"]).select("topic", "a", "b", "n"), total


def c_v(texts: DataFrame, chosen: DataFrame, window: int = WINDOW) -> DataFrame:
    """topic, c_v: mean cosine of each word's vector of normalised pointwise mutual information with the topic's sum of these.

    ``texts`` has doc_id and words, ``chosen`` topic, rank and term.  A word that never occurs has the information that EPSILON gives it.
    """
    pairs, total = window_counts(texts, chosen, window)
    found = pairs.unionByName(pairs.filter("a <> b").select("topic", F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    single = pairs.filter("a = b").select("topic", F.col("a").alias("r"), F.col("n").alias("f"))
    every = chosen.select("topic", F.col("rank").alias("a")).join(chosen.select("topic", F.col("rank").alias("b")), "topic")
    rows = every.join(found, ["topic", "a", "b"], "left")
    for side in ("a", "b"):
        rows = rows.join(single.select("topic", F.col("r").alias(side), F.col("f").alias(f"f{side}")), ["topic", side], "left")
    rows = rows.crossJoin(F.broadcast(total))  # one row
    share = lambda c: F.coalesce(c, F.lit(0)) / F.col("n_windows")
    joint = share("n") + EPSILON
    npmi = F.coalesce(F.ln(F.try_divide(joint, share("fa") * share("fb"))), F.lit(0.0)) / -F.ln(joint)
    rows = rows.select("topic", "a", "b", npmi.alias("v"))
    summed = rows.groupBy("topic", "b").agg(F.sum("v").alias("s"))
    cosine = rows.join(summed, ["topic", "b"]).groupBy("topic", "a").agg((F.sum(F.col("v") * F.col("s")) / F.sqrt(F.sum(F.col("v") ** 2)) / F.sqrt(F.sum(F.col("s") ** 2))).alias("c"))
    return cosine.groupBy("topic").agg(F.round(F.avg("c"), 6).alias("c_v"))


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id, words of cleaned texts."""
    return spread(docs).select("doc_id", tokens(clean_ascii(F.col("text"))).alias("words"))
