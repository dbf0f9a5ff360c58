"""Operator 7, byte-level BPE encoding and decoding with recursive DuckDB queries per partition.

Encoding.  A text falls into units at every single space between two other characters: the
splitting pattern always begins a piece there, so a unit's ids do not depend on its
surroundings.  Distinct units that a worker has not met are split by the pattern, and distinct
pieces go to DuckDB: one row per token position, joined to the merge table (every pair of
tokens whose bytes make a token, by rank); each recursion step contracts the leftmost pair of
least rank of every word, until no word has a pair.  Positions stay dense and rows know the
token to their right, so a step is one aggregation and one join by word, and no sort.

Decoding.  Ids fall into segments before each token that begins with a space, and after four
tokens.  The distinct segments of a batch go to DuckDB: positions join the vocabulary, and an
aggregation ordered by position strings the bytes together.

A piece of over ``LONG`` bytes would take a recursion step per merge over all its positions;
such pieces are merged with a heap over linked positions, in the same order.

Rows: null is the empty text (no ids).  Repeated rows are rows of their own; an empty table
gives no rows; other columns are ignored.  The cache of units is per Python worker and bounded; it
saves time only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import quoted

KEPT_UNITS = 600_000
LONG = 512
#: Words in one recursive query, characters of text taken at once, and tokens strung together at once.
WORDS, CHARS, GROUP = 10_000, 4_000_000, 2_000
#: Tokens of a segment, 16 bits each.
SEGMENT = 4

_UNIT = re.compile(r"(?<=\S) (?=\S)")
#: A text with none of these falls into units at its spaces.
_ODD = ("  ", " \n", "\n ", *(chr(c) for c in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def units(text: str) -> list[str]:
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _ODD):
        return _UNIT.split(text)
    return text.split(" ")

_ENCODE = """
with recursive s(step, w, p, t, nt, r) as (
  select 0, w, p, t, nt, m.rank from start left join merges m on m.pair = t::bigint * 65536 + nt
  union all
  (with best as (select w, min(r::bigint * 1099511627776 + p) as b from s where r is not null group by w),
   new as (select s.step + 1 as step, s.w, s.r, s.p - b.p as ahead,
       case when s.p > b.p then s.p - 1 else s.p end as p,
       case when s.p = b.p + 1 then b.t else s.t end as t,
       case when s.p = b.p - 1 then b.t else s.nt end as nt
     from s join (select w, (b >> 40)::int as t, (b & 1099511627775)::int as p from best) b on b.w = s.w where s.p <> b.p)
   select new.step, new.w, new.p, new.t, new.nt, case when abs(ahead) = 1 then m.rank else new.r end
   from new left join merges m on m.pair = case when abs(ahead) = 1 then new.t::bigint * 65536 + new.nt end)
),
ended as (select w, max(step) as step from s group by w)
select s.w, s.t from s join ended on s.w = ended.w and s.step = ended.step order by s.w, s.p"""

_DECODE = """
select g, string_agg(v.s, '' order by p) as s
from (select g, unnest(ids) as id, generate_subscripts(ids, 1) as p from segments) join vocab v using (id)
group by g order by g"""


class Coder:
    """One vocabulary with its DuckDB connection and caches."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        if max(self.ranks.values()) >= 65535:
            raise ValueError("pairs and segments take 16 bits a token")
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens])
        self.leads = np.array([t[:1] == b" " for t in self.tokens])
        self.units: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        pairs, made = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    made.append(rank)
        self._table("merges", {"pair": pa.array(pairs, pa.int64()), "rank": pa.array(made, pa.int32())})
        # A byte is held as the character 256 above it: text is what strings together, and no byte is special.
        text = ["".join(chr(256 + x) for x in t) for t in self.tokens]
        self._table("vocab", {"id": pa.array(range(len(text)), pa.int32()), "s": pa.array(text)})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from given")
        self.db.unregister("given")

    # encoding

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of 1 to LONG bytes, by the recursive query."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            t = self.single[np.frombuffer(b"".join(part), np.uint8)]
            p = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            last = np.zeros(len(t), bool)
            last[np.cumsum(sizes) - 1] = True
            self._table("start", {"w": pa.array(np.repeat(np.arange(len(part), dtype=np.int32), sizes)), "p": pa.array(p.astype(np.int32)), "t": pa.array(t), "nt": pa.array(np.append(t[1:], np.int32(0)), mask=last)})
            made = self.db.sql(_ENCODE).to_arrow_table()
            values = made.column("t").to_numpy().astype("<u4").tobytes()
            ends = [0, *(np.cumsum(np.bincount(made.column("w").to_numpy(), minlength=len(part))) * 4).tolist()]
            out += [values[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def merge_long(self, word: bytes) -> bytes:
        """Packed ids of one long word: pairs wait in a heap by rank, then position."""
        ranks = self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not left or j >= len(parts) or parts[j] is not right:
                continue  # one of the two has been merged
            parts[i], parts[j] = left + right, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else len(parts)
                if b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return np.array([ranks[x] for x in parts if x is not None], "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found: list = [None] * len(pieces)
        words, at = [], []
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                found[i] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                found[i] = self.merge_long(raw)
            else:
                words.append(raw)
                at.append(i)
        for i, ids in zip(at, self.merge_words(words)):
            found[i] = ids
        return found

    def _learn(self, words: list[str]) -> None:
        """Ids of the pieces that are a space and one of the words; such a piece is a unit's as well."""
        new = [w for w in set(words) if w not in self.units]
        self.units.update(zip(new, self._encode_pieces([" " + w for w in new])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32 bit) of every text."""
        split = [units(t) for t in texts]
        find = self.pattern.findall
        new = set().union(*(u[1:] for u in split))
        if len(self.units) > KEPT_UNITS:  # what this batch has again stays
            self.units = {u: self.units[u] for u in new if u in self.units}
        new.difference_update(self.units)
        plain, mixed = [], []  # ASCII letters after a space are one piece
        for u in new:
            (plain if u.isascii() and u.isalpha() else mixed).append(u)
        parts = [find(" " + u) for u in mixed]
        firsts = [find(u[0]) for u in split]
        others = set().union(*parts, *firsts)
        self._learn(plain + [p[1:] for p in others if p[0] == " "])
        loose = [p for p in others if p[0] != " "]
        found = dict(zip(loose, self._encode_pieces(loose)))
        for p in others:
            if p[0] == " ":
                found[p] = self.units[p[1:]]
        known = found.__getitem__
        self.units.update(zip(mixed, (b"".join(map(known, pieces)) for pieces in parts)))
        return [b"".join(map(known, first)) + b"".join(map(self.units.__getitem__, u[1:])) for first, u in zip(firsts, split)]

    # decoding

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of every packed id list."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        if not len(ids):
            return [b""] * len(packed)
        ends = np.cumsum([len(x) // 4 for x in packed])
        lead = self.leads[ids]
        lead[0] = True
        lead[ends[ends < len(ids)]] = True
        at = np.arange(len(ids))
        lead |= (at - np.maximum.accumulate(np.where(lead, at, 0))) % SEGMENT == 0
        start = np.flatnonzero(lead)
        # A segment of at most four tokens is one number of 64 bits.
        wide = np.append(ids.astype(np.uint64) + np.uint64(1), np.zeros(SEGMENT, np.uint64))
        size = np.diff(np.append(start, len(ids)))
        name = wide[start]
        for k in range(1, SEGMENT):
            name |= np.where(size > k, wide[start + k], np.uint64(0)) << np.uint64(16 * k)
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        whole, length = self._segments(ids, start[first], size[first])
        from_ = np.cumsum(length) - length
        length, from_ = length[which], from_[which]
        to = np.append(0, np.cumsum(length))
        out = whole[np.arange(to[-1]) + np.repeat(from_ - to[:-1], length)].tobytes()
        cuts = [0, *to[np.searchsorted(start, ends)].tolist()]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def _segments(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the segments one after another, by the ordered aggregation, and the length of each."""
        to = np.append(0, np.cumsum(size))
        tokens = ids[np.arange(to[-1]) + np.repeat(start - to[:-1], size)].astype(np.int32)
        # Some hundred segments make one group; the tokens' lengths tell them apart again.
        groups = np.append(np.arange(0, len(tokens), GROUP), len(tokens)).astype(np.int32)
        self._table("segments", {"g": pa.array(range(len(groups) - 1), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(groups), pa.array(tokens))})
        strings = self.db.sql(_DECODE).to_arrow_table().column("s").to_pylist()
        whole = np.frombuffer("".join(strings).encode("utf-16-le")[::2], np.uint8)
        return whole, np.add.reduceat(self.sizes[tokens], to[:-1])


_coders: dict[int, Coder] = {}


def _coder(ranks_file: bytes, pattern: str) -> Coder:
    key = hash((ranks_file, pattern))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks_file, pattern)
    return _coders[key]


def _vocabulary(path: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about CHARS bytes of the second column."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _ids_column(packed: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def encoded(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, check: bool = False) -> DataFrame:
    """The columns in ``keep`` (doc_id unless named), then n_tokens long and ids array<int>; with ``check`` also decoded_sha256, of the bytes the ids decode to."""
    kept = docs.select(*(keep or ["doc_id"]))
    vocabulary = docs.sparkSession.sparkContext.broadcast(_vocabulary(path))  # the vocabulary file, whatever the input's size
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_tokens long, ids array<int>" + (", decoded_sha256 string" if check else "")
    names = [*kept.columns, "n_tokens", "ids"] + ["decoded_sha256"] * check
    given = docs.select(F.struct(*quoted(kept)).alias("k"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*vocabulary.value)
        for batch in batches:
            for part in _parts(batch):
                packed = coder.encode([t or "" for t in part.column(1).to_pylist()])
                keys = part.column(0).flatten()
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in coder.decode(packed)], pa.string())] if check else []
                yield pa.RecordBatch.from_arrays([*keys, pa.array([len(x) // 4 for x in packed], pa.int64()), _ids_column(packed), *digests], names=names)

    return given.mapInArrow(run, ddl)


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, bytes binary."""
    vocabulary = ids.sparkSession.sparkContext.broadcast(_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*vocabulary.value)
        for batch in batches:
            packed = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(packed), pa.binary())], names=["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, and decodes the ids, in one pass over the partition."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(_vocabulary(path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*vocabulary.value)
        for batch in batches:
            for part in _parts(batch):
                packed = coder.encode([t or "" for t in part.column(1).to_pylist()])
                digests = [hashlib.sha256(x).hexdigest() for x in coder.decode(packed)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array(digests)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
