"""Operator 5, near-duplicate embeddings by cross-polytope hashing.

A hash function rotates a vector by three rounds of random signs and a fast Hadamard transform
and takes the signed axis it lies closest to.  A bucket is ``k`` such values; a vector enters
its own bucket in each of ``l`` tables and, as probes, the buckets in which one value is its
second-best axis.  Two vectors meet where the own bucket of one is an own or probed bucket of
the other.  ``k`` grows with the logarithm of the number of vectors, so that unrelated vectors
rarely meet; ``l`` is what recall at the threshold then takes, worked out on random pairs that
lie exactly at the threshold.

Equal vectors are one class with a weight.  Buckets are cut into blocks of bounded size, and
pairs of blocks are compared by one matrix product, in double precision.  A pair that meets in
several buckets is counted in the first of them only, which both vectors' key lists tell.  No
pair is ever a row: a block gives its vectors' weighted link counts and, for the components,
links to the least vector of each local component.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing;
vectors of different lengths do not link.  Repeated rows, and rows of one id with different
vectors, are rows of their own: each counts its own links.  Rows without an id are linked as all
others, have the least id of their component (null, if it has none), and are kept.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import written
from revlake.llm.graph import components, join_hubs, local_roots

SEED = 20240501
#: Rows of a block; share of pairs at the threshold that must meet.
BLOCK, RECALL = 256, 0.999


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), not normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


@lru_cache(maxsize=8)
def _signs(d: int, functions: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).choice([-1.0, 1.0], size=(functions, 3, d))


def keys(x: np.ndarray, k: int, l: int) -> np.ndarray:
    """Bucket keys of unit rows: (rows, l, 1 + k), the own bucket and then the probes."""
    n, width = x.shape
    d = max(2, 1 << (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - width)))
    signs = _signs(d, k * l)
    out = np.empty((n, l, 1 + k), np.int64)
    rows = np.arange(n)
    for t in range(l):
        first, second = np.empty((k, n), np.int64), np.empty((k, n), np.int64)
        for j in range(k):
            y = x
            for s in signs[t * k + j]:
                y = hadamard(y * s)
            size = np.abs(y)
            a = size.argmax(1)
            size[rows, a] = -1
            b = size.argmax(1)
            first[j], second[j] = a + d * (y[rows, a] < 0), b + d * (y[rows, b] < 0)
        place = (2 * d) ** np.arange(k, dtype=np.int64)
        out[:, t, 0] = own = place @ first
        for j in range(k):
            out[:, t, 1 + j] = own + (second[j] - first[j]) * place[j]
    return out


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For key arrays (pairs, l, 1 + k): does the pair meet in each table?"""
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


@lru_cache(maxsize=32)
def tables(width: int, n: int, threshold: float) -> tuple[int, int]:
    """(k, l) for n vectors of this width."""
    d = max(2, 1 << (width - 1).bit_length())
    bits = (2 * d).bit_length() - 1
    k = max(1, min(62 // bits, math.ceil(math.log2(8 * max(n, 1)) / bits)))
    rng = np.random.default_rng([SEED, width])
    a, b = rng.standard_normal((2, 1500, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    if width > 1:
        b -= (a * b).sum(1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1)[:, None], 1e-300)
    near = threshold * a + math.sqrt(1 - threshold**2) * b if width > 1 else a
    met = meet(keys(a, k, 8), keys(near, k, 8)).mean()
    return k, 2 if met >= 1 else max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - max(met, 1e-4))))


def _unit(embedding: list | None) -> np.ndarray | None:
    if not embedding or any(v is None for v in embedding):
        return None
    x = np.asarray(embedding, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, key: 16 bytes that name the vector's value, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for e in batch.column(1).to_pylist():
                x = _unit(e)
                found.append(None if x is None else hashlib.blake2b((np.asarray(e, np.float64) + 0.0).tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(1)], names=["vec_id", "key", "embedding"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return given.mapInArrow(run, "vec_id long, key binary, embedding array<double>")


def _hashed(reps: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = part.column(2).to_pylist()
                found: list = [None] * len(vectors)
                for width in {len(v) for v in vectors}:
                    rows = [i for i, v in enumerate(vectors) if len(v) == width]
                    x = np.stack([_unit(vectors[i]) for i in rows])
                    for i, ks in zip(rows, keys(x, *plan[width]).reshape(len(rows), -1)):
                        found[i] = ks
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(found, pa.list_(pa.int64()))], names=["rep", "n", "embedding", "keys"])

    return reps.select("rep", "n", "embedding").mapInArrow(run, "rep long, n long, embedding array<double>, keys array<long>")


def compare(rep, n, side, x, ks, spot: tuple[int, int], parts: tuple[int, int], threshold: float):
    """One pair of blocks of one bucket -> (rep, links, least linked rep of the local component) of rows with links.

    ``spot`` is the bucket (table, key).  With two different blocks only pairs across count.
    """
    t, key = spot
    own = ks[:, t, 0] == key
    near = (x @ x.T >= threshold) & (own[:, None] | own[None, :])
    np.fill_diagonal(near, False)
    if parts[0] != parts[1]:
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(near))
    if not len(a):
        return None
    counted = np.zeros(len(a), bool)
    for at in range(0, len(a), 8192):
        s = slice(at, at + 8192)
        one, two = ks[a[s]], ks[b[s]]
        # In this table they may meet in the own buckets of both; the lesser counts.
        by_one, by_two = (one[:, t, :1] == two[:, t]).any(1), (two[:, t, :1] == one[:, t]).any(1)
        spot_of = np.where(by_one & by_two, np.minimum(one[:, t, 0], two[:, t, 0]), np.where(by_one, one[:, t, 0], two[:, t, 0]))
        counted[s] = ~meet(one[:, :t], two[:, :t]).any(1) & (spot_of == key)
    links = np.bincount(a[counted], n[b[counted]], len(rep)) + np.bincount(b[counted], n[a[counted]], len(rep))
    root = local_roots(near)
    rows = near.any(1)
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, root, rep)
    return rep[rows], links[rows].astype(np.int64), least[root][rows]


_NAMES = ["rep", "links", "least"]


def _compared(blocks: DataFrame, plan: dict[int, tuple[int, int]], threshold: float) -> DataFrame:
    """Rows of block pairs, sorted by block pair within partitions -> results of ``compare``."""

    def one(rows: pa.Table):
        width = len(rows.column("embedding")[0])
        k, l = plan[width]
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
        x = flat("embedding").reshape(-1, width)
        x = x / np.abs(x).max(1)[:, None]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        ks = flat("keys").reshape(-1, l, 1 + k)
        first = [rows.column(c)[0].as_py() for c in ("t", "key", "i", "j")]
        return compare(rows.column("rep").to_numpy(), rows.column("n").to_numpy().astype(np.float64), rows.column("part").to_numpy(), x, ks, tuple(first[:2]), tuple(first[2:]), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def results(table: pa.Table, cuts: list[int]):
            found = [r for a, b in zip(cuts, cuts[1:]) if b - a > 1 and (r := one(table.slice(a, b - a))) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=_NAMES)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            spots = np.stack([table.column(c).to_numpy() for c in ("w", "t", "key", "i", "j")])
            cuts = [0, *(np.flatnonzero((spots[:, 1:] != spots[:, :-1]).any(0)) + 1).tolist()]
            yield from results(table, cuts)
            held = table.slice(cuts[-1])
        if held is not None:
            yield from results(held, [0, held.num_rows])

    return blocks.mapInArrow(run, "rep long, links long, least long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = written(classes(vectors), "vectors")
    # A class is named by a number of its own, which is read back with the class: ids may be null or repeat.
    grouped = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    reps = written(grouped.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    widths = {r.w: r.n for r in reps.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = {w: tables(w, 1 << (n - 1).bit_length(), threshold) for w, n in widths.items()}
    hashed = written(_hashed(reps, plan), "vector-keys")
    probes = F.create_map(*(F.lit(v) for w, (k, _) in plan.items() for v in (w, 1 + k))) if plan else F.create_map(F.lit(0), F.lit(1))
    spread = hashed.select("rep", F.size("embedding").alias("w"), F.posexplode("keys").alias("pos", "key")).withColumn("per", F.element_at(probes, F.col("w")))
    entries = spread.select("rep", "w", F.floor(F.col("pos") / F.col("per")).cast("int").alias("t"), "key", (F.pmod("pos", "per") == 0).alias("own"))
    entries = entries.groupBy("w", "t", "key", "rep").agg(F.max("own").alias("own"))  # a probe can equal another
    sizes = entries.groupBy("w", "t", "key").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("any_own")).filter("m > 1 and any_own").select("w", "t", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    met = entries.join(sizes, ["w", "t", "key"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = met.select("w", "t", "key", "rep", "part", other.alias("with")).select("w", "t", "key", "rep", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    blocks = paired.join(hashed, "rep").repartition("w", "t", "key", "i", "j").sortWithinPartitions("w", "t", "key", "i", "j")
    found = written(_compared(blocks.select("w", "t", "key", "i", "j", "part", "rep", "n", "embedding", "keys"), plan, threshold), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "least").withColumnRenamed("id", "rep")
    named = written(reps.select("key", "rep", "n", "first_id").join(links, "rep", "left").join(roots, "rep", "left").select("key", "n", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")), "vector-named")
    total = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = written(join_hubs(named, ends, "root", "size", total[0]).select("key", "n", F.col("n").alias("rows"), "links", "component_id"), "vector-components")
    linked = join_hubs(rows.select("vec_id", "key").filter("key is not null"), named, "key", "rows", total[1])
    linked = linked.select("vec_id", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
