"""Operator 9, token counts of every prefix by dynamic programming.

A SentencePiece BPE model merges the best-scored adjacent pair, leftmost first.  Two facts make
its encodings a dynamic program over prefixes.  A piece holds spaces at its front only, no line
ends, and either Latin letters or other characters (checked at load), so no merge crosses such a
border: texts fall into chunks, a run of letters or of other characters with the spaces before.  And inside a chunk a piece sequence is the model's own
if and only if each adjacent pair is; so of the pieces that end a prefix exactly one fits the
last piece of the rest, and ``count[i] = count[i - len(piece)] + 1``.  Characters without a
piece are as many byte pieces as they have UTF-8 bytes, and nothing merges with them.

The counts at chunk ends add up along the text, and each chunk's table has the counts inside
it.  Together they are one array with the exact count at every prefix; with the least count from
each prefix on beside it, a length or a budget is one look-up and nothing is encoded again.

Rows: null is the empty text (0 tokens).  Repeated rows are rows of their own; an empty table
gives no rows; other columns are ignored.  Chunk tables are kept per Python worker, at most ``KEPT`` of them
with ``CODE_POINTS`` in all (and those of the text at hand); the bounds only cost time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 800_000
CODE_POINTS = 16_000_000
_LETTERS = "A-Za-z\u00c0-\u024f\u1e00-\u1eff"
_CHUNK = re.compile(rf" +(?:[{_LETTERS}]+|[^ \n{_LETTERS}]*)|[{_LETTERS}]+|[^ \n{_LETTERS}]+|\n")


class PrefixCounter:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i).replace("▁", " ")] = sp.get_score(i)
        if not all(map(_CHUNK.fullmatch, self.score)):
            raise ValueError("this model has pieces across the borders of chunks")
        #: Every ending of a piece -> is it a piece?
        self.endings = {p[k:]: p[k:] in self.score for p in self.score for k in range(len(p))}
        self.fits: dict[tuple[str, str], bool] = {}
        #: Chunk -> tokens of each of its prefixes, a byte each where that is enough.
        self.tables: dict[str, Sequence[int]] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by its merges."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def table(self, chunk: str) -> list[int]:
        """Tokens of chunk[:i] for i = 0 .. len(chunk)."""
        endings, fits = self.endings, self.fits
        count, last = [0], [None]
        for i in range(1, len(chunk) + 1):
            found, begins = None, []
            for begin in range(i - 1, -1, -1):
                whole = endings.get(chunk[begin:i])
                if whole is None:
                    break
                if whole:
                    begins.append(begin)
            for begin in reversed(begins):
                piece, before = chunk[begin:i], last[begin]
                ok = before is None or fits.get((before, piece))
                if ok is None:
                    if len(fits) > KEPT:
                        fits.clear()
                    ok = fits[before, piece] = self.merged(before + piece) == [before, piece]
                if ok:
                    found = piece
                    count.append(count[begin] + 1)
                    break
            if not found:
                count.append(count[i - 1] + len(chunk[i - 1].encode("utf-8", "surrogatepass")))
            last.append(found)
        return count

    @staticmethod
    def chunks(text: str) -> list[str]:
        return _CHUNK.findall(" " + text.replace("▁", " ")) if text else []

    def learn(self, chunks: set[str]) -> None:
        if len(self.tables) > KEPT or self.held > CODE_POINTS:
            self.tables.clear()
            self.held = 0
        for c in chunks.difference(self.tables):
            table = self.table(c)
            self.tables[c] = bytes(table) if max(table) < 256 else array("q", table)
            self.held += len(c)

    def count(self, text: str) -> int:
        chunks = self.chunks(text)
        distinct = set(chunks)
        self.learn(distinct)
        ends = {c: self.tables[c][-1] for c in distinct}
        return sum(map(ends.__getitem__, chunks))

    def prefixes(self, text: str) -> "PrefixCounts":
        return PrefixCounts(self, text)


class PrefixCounts:
    """Exact token counts of all prefixes of one text: ``tokens[k]`` of text[:k]; ``ends`` are the ends of its chunks."""

    def __init__(self, counter: PrefixCounter, text: str):
        parts = counter.chunks(text)
        counter.learn(set(parts))
        self.tokens, ends, at, before = np.zeros(len(text) + 1, np.int64), [], -1, 0  # the first space is the model's own
        for c in parts:
            table = counter.tables[c]
            skip = max(1, 1 - at)  # a prefix of no characters has no tokens, not even that space
            if skip < len(table):
                self.tokens[at + skip : at + len(table)] = np.asarray(memoryview(table))[skip:] + np.int64(before)
            at += len(c)
            before += table[-1]
            ends.append(at)
        self.ends = ends
        #: The least count of this prefix and all longer ones; it never falls.
        self.least = np.minimum.accumulate(self.tokens[::-1])[::-1]

    def at(self, length: int) -> int:
        """Tokens of text[:length]."""
        return int(self.tokens[min(max(length, 0), len(self.tokens) - 1)])

    def longest(self, budget: int) -> int:
        """Length of the longest prefix with at most ``budget`` tokens."""
        return max(int(np.searchsorted(self.least, budget, "right")) - 1, 0)


_counters: dict[int, PrefixCounter] = {}


def _counter(model: bytes) -> PrefixCounter:
    key = hash(model)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(model)
    return _counters[key]


def _model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, row, schema: pa.Schema, ddl: str, path: str | None) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(_model(path))  # the model file, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [row(counter, i, t or "") for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def row(counter: PrefixCounter, doc_id, text: str) -> tuple:
        n = counter.count(text)
        return doc_id, len(text.encode()), n, n > limit

    return _mapped(docs, row, schema, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", path)


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ends (code points at chunk ends), tokens (exact tokens of every prefix, by its length in code points from 0 on)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ends", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    def row(counter: PrefixCounter, doc_id, text: str) -> tuple:
        p = counter.prefixes(text)
        return doc_id, p.ends, p.tokens

    return _mapped(docs, row, schema, "doc_id long, ends array<long>, tokens array<long>", path)


def within(tables: DataFrame, budget: int) -> DataFrame:
    """doc_id, length, n_tokens: the longest prefix of at most ``budget`` tokens, from stored ``prefix_tables`` alone."""
    fitting = F.transform("tokens", lambda n, k: F.when(n <= budget, k))
    rows = tables.select("doc_id", "tokens", F.coalesce(F.array_max(fitting), F.lit(0)).cast("long").alias("length"))
    return rows.select("doc_id", "length", F.get("tokens", F.col("length").cast("int")).alias("n_tokens"))


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, text, n_tokens: the longest prefix of each text with at most ``budget`` tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64())])

    def row(counter: PrefixCounter, doc_id, text: str) -> tuple:
        p = counter.prefixes(text)
        k = p.longest(budget)
        return doc_id, text[:k], p.at(k)

    return _mapped(docs, row, schema, "doc_id long, text string, n_tokens long", path)
