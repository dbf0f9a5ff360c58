"""Operator 12, centroid clustering in integers, screened by norms of blocks.

Vectors of exactly DIMENSIONS finite components take part; component x becomes floor(64 x).  A vector is
compressed to multiples of STEP, x = y + e.  The squared norms of the SEGMENTS segments of x and of e are
written with it once.  By Cauchy and Schwarz the product of two vectors is at most the sum of the products of
their segments' norms, so both

    |x|^2 + |c|^2 - 2 sum_s |x_s| |c_s|    and    |x|^2 + |c|^2 - 2 (y c + sum_s |e_s| |c_s|)

are at most |x - c|^2: the first from SEGMENTS numbers a pair, the second from the compressed vector too, by one
product of matrices for a block of vectors.  The centroid of the least
bound gets an exact distance first; of the others only those whose bound does not exceed it (less the error
that square roots can bring).  All distances are integers; ties go to the smaller number.

Each round is one pass over the written vectors.  The centroids, 16 of 64 numbers, are all that leaves the driver; sums
and numbers of vectors by cluster are made in the tasks and once more by a grouping of at most 1,024 keys.

Rows: a vector that is null, has another number of components, or holds a null or non-finite one is left out.
Repeated vec_ids are rows of their own (of equal ones the smaller vector, by components, is the earlier centroid, vectors with a component of SMALL or more last); a row without
a vec_id is assigned but is a first centroid only after all that have one.  Fewer vectors than centroids make fewer centroids; an empty
table gives no rows; other columns are ignored.  Components may have any size: blocks whose squares could pass 64 bits
are reckoned in Python's integers, and a distance or inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import written

DIMENSIONS, SEGMENTS = 64, 8
CLUSTERS, ROUNDS = 16, 3
SCALE = 64
#: Compressed vectors hold multiples of this.
STEP = 4
#: Components below this keep the squares of differences, summed over a vector, within 62 bits.
SMALL = 1 << 27
#: Vectors that are compared at once.
BLOCK = 8192
#: Greatest value of a long.
LONG = (1 << 63) - 1


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the components), norms (of the segments of v and of what compression leaves, squared); only vectors that take part.

    A vector with a component of SMALL or more has its components as strings in ``big`` and no v and norms.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("big", pa.list_(pa.string())), ("norms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            of = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            value = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null is nan
            bad = np.zeros(len(batch), bool)
            bad[of[~np.isfinite(value)]] = True
            keep = (length == DIMENSIONS) & ~bad
            scaled = np.floor(value[keep[of]].reshape(-1, DIMENSIONS) * SCALE)
            large = np.abs(scaled).max(1, initial=0) >= SMALL
            v = np.where(large[:, None], 0, scaled).astype(np.int64)
            norms = _norms(v)
            big = [[str(int(x)) for x in scaled[i]] if large[i] else None for i in range(len(v))] if large.any() else [None] * len(v)
            ids = batch.column(0).filter(pa.array(keep))
            for at in range(0, len(v), BLOCK):
                part = slice(at, at + BLOCK)
                yield pa.RecordBatch.from_arrays([ids[part], _lists(v[part], large[part]), pa.array(big[part], schema.types[2]), _lists(norms[part], large[part])], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v array<long>, big array<string>, norms array<long>")


def _lists(table: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    """Rows of a table as lists; null where missing."""
    offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.reshape(-1)), mask=pa.array(missing))


def _segments(v: np.ndarray) -> np.ndarray:
    return (v * v).reshape(len(v), SEGMENTS, DIMENSIONS // SEGMENTS).sum(2)


def _compressed(v: np.ndarray) -> np.ndarray:
    return (v + STEP // 2) // STEP * STEP


def _norms(v: np.ndarray) -> np.ndarray:
    return np.concatenate([_segments(v), _segments(v - _compressed(v))], 1)


def lower_bounds(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Bounds of the squared distances of every vector to every centroid, as doubles."""
    of, own = norms.astype(np.float64), _segments(centroids).astype(np.float64)
    roots, own_roots = np.sqrt(of), np.sqrt(own)
    squares = of[:, :SEGMENTS].sum(1)[:, None] + own.sum(1)[None, :]
    product = np.minimum(roots[:, :SEGMENTS] @ own_roots.T, _compressed(v).astype(np.float64) @ centroids.astype(np.float64).T + roots[:, SEGMENTS:] @ own_roots.T)
    return squares * (1 - 1e-12) - 2 * product - 1  # the error of sums and square roots is far below 1e-12 of the squares


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, the squared distance, and how many exact distances it took.

    All arrays hold int64 below SMALL, or Python integers.
    """
    least = lower_bounds(v, norms, centroids)
    first = least.argmin(1)
    best, n_exact = first.copy(), np.ones(len(v), np.int32)
    difference = v - centroids[first]
    distance = (difference * difference).sum(1)
    for c in range(len(centroids)):
        at = np.flatnonzero((least[:, c] <= distance.astype(np.float64) * (1 + 1e-12)) & (first != c))
        difference = v[at] - centroids[c]
        d = (difference * difference).sum(1)
        better = (d < distance[at]) | ((d == distance[at]) & (c < best[at]))
        best[at[better]], distance[at[better]] = c, d[better]
        n_exact[at] += 1
    return best, distance, n_exact


def _blocks(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, vectors, norms) of the columns v, big and norms: int64 where that is enough, else Python's integers."""
    v, big, norms = batch.column("v"), batch.column("big"), batch.column("norms")
    plain = v.is_valid().to_numpy(zero_copy_only=False)
    fits = bool((np.abs(centroids) < SMALL).all())
    at = np.flatnonzero(plain)
    if len(at):
        found = v.flatten().to_numpy().reshape(-1, DIMENSIONS), norms.flatten().to_numpy().reshape(-1, 2 * SEGMENTS)
        for k in range(0, len(at), BLOCK):
            yield at[k : k + BLOCK], *(x[k : k + BLOCK] if fits else x[k : k + BLOCK].astype(object) for x in found)
    at = np.flatnonzero(~plain)
    for k in range(0, len(at), BLOCK):
        large = np.array([[int(x) for x in big[i].as_py()] for i in at[k : k + BLOCK].tolist()], object)
        yield at[k : k + BLOCK], large, _norms(large)


def _fit(centroids: np.ndarray, v: np.ndarray) -> np.ndarray:
    return centroids.astype(object) if v.dtype == object else centroids.astype(np.int64)


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``1:<vec_id>``, in the order of these."""
    rows = kept.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), F.asc_nulls_last("v"), "big").select("v", "big").limit(clusters).collect()
    return np.array([r.v if r.v is not None else [int(x) for x in r.big] for r in rows], object).reshape(-1, DIMENSIONS)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; one without vectors stays."""
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64())])
    mass = 1 << 31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), DIMENSIONS), object)
        counts = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, norms in _blocks(batch, centroids):
                best, _, _ = nearest(v, norms, _fit(centroids, v))
                counts += np.bincount(best, minlength=len(centroids))
                for c in np.unique(best).tolist():
                    sums[c] += v[best == c].sum(0).astype(object)  # below BLOCK x SMALL where it is an int64
        for c in np.flatnonzero(counts).tolist():
            digits = [(k, x) for k, x in enumerate(sums[c])]
            rows = []
            for k, x in digits:  # in powers of 2^31, as sums may pass a long
                power = 0
                while x not in (0, -1) or power == 0:
                    rows.append((c, k, power, int(x % mass), int(counts[c])))
                    x, power = x // mass, power + 1
                if x == -1:
                    rows.append((c, k, power, -1, int(counts[c])))
            yield pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(zip(*rows), schema.types)], schema=schema)

    found = kept.mapInArrow(run, "cluster int, place int, high long, low long, n long").groupBy("cluster", "place", "high").agg(F.sum("low").alias("low"), F.sum(F.when(F.col("high") == 0, F.col("n"))).alias("n"))
    sums, counts = np.zeros((len(centroids), DIMENSIONS), object), np.zeros(len(centroids), object)
    for r in found.collect():  # clusters x components x powers
        sums[r.cluster, r.place] += r.low * mass**r.high
        if r.n is not None:
            counts[r.cluster] = r.n
    return np.array([[x // n for x in s] if n else list(c) for s, n, c in zip(sums, counts, centroids)], object).reshape(-1, DIMENSIONS)


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (null beyond a long), n_exact (distances taken, the others were screened off)."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("n_exact", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v, norms in _blocks(batch, centroids):
                best, distance, n_exact = nearest(v, norms, _fit(centroids, v))
                long = [d if d <= LONG else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(best.astype(np.int32)), pa.array(long, pa.int64()), pa.array(n_exact)], schema=schema)

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long, n_exact int")


def _long_sum(name: str):
    """Sum of a column of longs, null where a summand is missing or it passes a long."""
    total = F.sum(F.col(name).cast("decimal(38,0)"))
    return F.when((F.count(name) == F.count(F.lit(1))) & (total <= LONG), total).cast("long")


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, n_exact) of every vector that takes part, written, and the centroids."""
    kept = written(kept_vectors(vectors), "vectors")
    centroids = first_centroids(kept, k)
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    return written(assigned(kept, centroids), "assigned"), centroids


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = clusters(vectors)
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    of_all = found.agg(_long_sum("distance").alias("inertia"))
    of_each = found.groupBy("cluster").agg(_long_sum("distance").alias("cluster_inertia")).crossJoin(F.broadcast(of_all))  # k rows and one
    return found.join(F.broadcast(of_each.join(named, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle_sql() -> str:
    """Rounds are written out; sums are by component."""
    steps = [
        f"""kept as (select row_number() over (order by vec_id) as i, vec_id, list_transform(embedding, lambda x: floor(x::double * {SCALE})::hugeint) as v
  from embeddings where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as (select row_number() over (order by h) - 1 as cluster, v from (select sha256('1:' || vec_id) as h, v from kept order by h limit {CLUSTERS}))",
    ]
    for k in range(ROUNDS + 1):
        distance = "list_sum(list_transform(range(1, len(a.v) + 1), lambda j: (a.v[j] - c.v[j]) * (a.v[j] - c.v[j])))"
        steps.append(f"a{k} as (select a.i, a.vec_id, a.v, c.cluster, {distance}::bigint as distance from kept a cross join c{k} c qualify row_number() over (partition by a.i order by distance, c.cluster) = 1)")
        if k < ROUNDS:
            steps.append(f"p{k} as (select cluster, generate_subscripts(v, 1) as j, unnest(v) as x from a{k})")
            steps.append(f"q{k} as (select cluster, j, sum(x)::hugeint as s, count(*)::hugeint as n from p{k} group by all)")
            # floor of a quotient of whole numbers, of either sign
            steps.append(f"r{k} as (select cluster, list((s - (((s % n) + n) % n)) // n order by j) as v from q{k} group by cluster)")
            steps.append(f"c{k + 1} as (select c.cluster, coalesce(r.v, c.v) as v from c{k} c left join r{k} r on r.cluster = c.cluster)")
    last = ROUNDS
    return (
        "with "
        + ",\n".join(steps)
        + f"""
select vec_id, a.cluster::int as cluster, distance, sum(distance) over (partition by a.cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::varchar), ',')) as centroid_sha256
from a{last} a join c{last} c on c.cluster = a.cluster
"""
    )


ORACLE_SQL = _oracle_sql()
