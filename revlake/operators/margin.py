"""Linear classifiers with a squared hinge: several problems over the same rows are fitted in the same passes.

Each problem has a target of 1 or -1 and a cost a row (0 leaves the row out) and minimises

    |w|^2 / 2 + C sum_i cost_i max(0, 1 - target_i (w x_i + b))^2,

b counted in w.  The logistic loss is fitted likewise, with b left free.  Rows are sparse sublinear tf-idf vectors of unit length, encoded once in Arrow
batches; problems may weigh terms by vocabularies of their own.  A pass sends the weights to all tasks and adds the gradients up in the tasks,
then in a few groups, then on the driver: as many numbers as problems times terms, whatever the rows.  L-BFGS is told the
directions of great curvature first and needs some dozens of passes; a problem ends when its gradient proves that its objective is
within GAP of the least, which the first term of the objective allows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative distance from the least objective; most passes; steps that L-BFGS remembers; tasks whose gradients the driver adds.
GAP, PASSES, MEMORY, GROUPS = 1e-5, 200, 10, 16
#: Rows of a block, and terms (the most frequent ones) whose entries are a dense matrix there.
BLOCK, HEAD = 512, 2_048
#: Directions of great curvature that L-BFGS is told beforehand.
DIRECTIONS = 64
#: Numbers of few tasks that the driver adds itself; more are added up by a task first.
COLLECTED = 2_000_000


def encoder(spark: SparkSession, terms: list[str], idf: list[float]) -> Callable[[str], Column]:
    """From a column of terms to a struct of places and values: 1 + ln tf, times idf, of unit length."""
    shared = spark.sparkContext.broadcast((pa.array(terms, pa.string()), np.array(idf, float)))

    @F.arrow_udf("struct<at: array<int>, x: array<double>>")
    def encoded(words: pa.Array) -> pa.Array:
        names, weight = shared.value
        found = pc.index_in(words.flatten(), value_set=names)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(length)), length)[known].astype(np.int64)
        pair, n = np.unique(row * len(weight) + found.drop_null().to_numpy().astype(np.int64), return_counts=True)
        at = pair % max(1, len(weight))
        x = (1 + np.log(n)) * weight[at]
        of = pair // max(1, len(weight))
        x = x / np.sqrt(np.bincount(of, x * x, len(length)))[of]
        offsets = pa.array(np.searchsorted(of, np.arange(len(length) + 1)).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x))], names=["at", "x"])

    return lambda words: encoded(F.col(words))


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every entry of a batch of structs."""
    at, x = column.field("at"), column.field("x")
    row = pc.list_parent_indices(at).to_numpy(zero_copy_only=False)
    return row, at.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Problem:
    """What a problem takes of the encoded rows: places of its target and cost, of its vocabulary, and its C."""

    target: int
    cost: int
    vocabulary: int
    c: float


def merged(vocabularies: list[tuple[list[str], list[float]]]) -> tuple[list[str], np.ndarray]:
    """All terms of several vocabularies, frequent ones first, and the idf of each vocabulary, 0 for terms that it lacks."""
    best: dict[str, int] = {}
    for terms, _ in vocabularies:
        for rank, t in enumerate(terms):
            best[t] = min(rank, best.get(t, rank))
    names = sorted(best, key=lambda t: (best[t], t)) if len(vocabularies) > 1 else list(vocabularies[0][0])
    place = {t: i for i, t in enumerate(names)}
    weights = np.zeros((len(vocabularies), len(names)))
    for k, (terms, idf) in enumerate(vocabularies):
        weights[k, [place[t] for t in terms]] = idf
    return names, weights


def blocks(rows: DataFrame, terms: list[str], idf: np.ndarray, targets: list[Column], costs: list[Column]) -> DataFrame:
    """Rows of ``terms`` as sparse matrices of up to BLOCK rows: 1 + ln tf by place, 1 over the length under each idf, targets and costs."""
    shared = rows.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                some = batch.slice(first, BLOCK)
                n, words = some.num_rows, some.column(0)
                found = pc.index_in(words.flatten(), value_set=names)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), length)[known].astype(np.int64)
                pair, times = np.unique(row * len(names) + found.drop_null().to_numpy().astype(np.int64), return_counts=True)
                row, at = (pair // max(1, len(names))).astype(np.int32), (pair % max(1, len(names))).astype(np.int32)
                x = 1 + np.log(times)
                square = np.stack([np.bincount(row, (x * w[at]) ** 2, n) for w in idf], 1)
                unit = np.where(square > 0, 1 / np.sqrt(np.where(square > 0, square, 1)), 0.0)
                sides = [some.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) for k in (1, 2)]
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in zip(_PARTS, (row, at, x, unit, *sides))}})

    plain = rows.select("terms", F.array(*(t.cast("double") for t in targets)).alias("target"), F.array(*(w.cast("double") for w in costs)).alias("cost"))
    return plain.mapInArrow(run, "n int, " + ", ".join(f"{k} binary" for k in _PARTS))


_PARTS = ("row", "at", "x", "unit", "target", "cost")


class _Block:
    """One block in a task.  The places below HEAD, which most entries have, are a dense matrix, the others are added up one by one."""

    def __init__(self, batch: pa.RecordBatch, i: int, size: int):
        self.n = n = batch.column(0)[i].as_py()
        read = lambda k, kind: np.frombuffer(batch.column(k)[i].as_buffer(), kind)
        row, at, x = read(1, np.int32), read(2, np.int32), read(3, float)
        self.unit, self.target, self.cost = (read(k, float).reshape(n, -1) for k in (4, 5, 6))
        self.head = np.zeros((n, min(HEAD, size)))
        near = at < HEAD
        self.head[row[near], at[near]] = x[near]
        self.row, self.at, self.x = row[~near], at[~near], x[~near]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Rows by problems; ``weights`` is problems by places."""
        out = self.head @ weights[:, : self.head.shape[1]].T
        if len(self.at):
            for p, w in enumerate(weights):
                out[:, p] += np.bincount(self.row, self.x * w[self.at], self.n)
        return out

    def add_to(self, sums: np.ndarray, slopes: np.ndarray) -> None:
        """Adds rows times ``slopes`` (rows by problems) to ``sums`` (problems by places)."""
        sums[:, : self.head.shape[1]] += slopes.T @ self.head
        if len(self.at):
            for p in range(len(sums)):
                sums[p] += np.bincount(self.at, self.x * slopes[self.row, p], sums.shape[1])


def _pass(made: DataFrame, size: int, numbers: int, shared: object, work: Callable[[_Block, object, np.ndarray], None]) -> np.ndarray:
    """``numbers`` sums over all blocks, which ``work`` adds to; they are added up in the tasks, then in GROUPS, then on the driver."""
    sent = made.sparkSession.sparkContext.broadcast(shared)
    schema = "slot int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros(numbers)
        for batch in batches:
            for i in range(batch.num_rows):
                work(_Block(batch, i, size), sent.value, sums)
        if sums.any():
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(numbers)
        for batch in batches:
            for x in batch.column(1):
                sums += np.frombuffer(x.as_buffer())
        if sums.any():
            yield pa.RecordBatch.from_pydict({"slot": pa.array([0], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    # Each task has all sums, so there are as many tasks as cores.
    tasks = made.sparkSession.sparkContext.defaultParallelism
    found = made.coalesce(tasks).mapInArrow(run, schema)
    if tasks > 2 * GROUPS:
        found = found.repartition(GROUPS, "slot").mapInArrow(added, schema)
    elif tasks * numbers > COLLECTED:
        found = found.repartition(1).mapInArrow(added, schema)
    total = np.zeros(numbers)
    for batch in found.toArrow().to_batches():
        for x in batch.column(1):
            total += np.frombuffer(x.as_buffer())
    sent.destroy()
    return total


def objective(made: DataFrame, idf: np.ndarray, problems: list[Problem], weights: np.ndarray, logistic: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Objectives and gradients of problems (rows of ``weights``, the last number is b) over ``blocks``; with the logistic loss b is not counted in w."""
    of = [p.vocabulary for p in problems]
    target, cost, c = [p.target for p in problems], [p.cost for p in problems], np.array([p.c for p in problems])
    size, width = idf.shape[1], len(problems)

    def work(block: _Block, shared: tuple[np.ndarray, np.ndarray], sums: np.ndarray) -> None:
        w, b = shared
        unit, y, weight = block.unit[:, of], block.target[:, target], block.cost[:, cost] * c
        z = y * (block.times(w) * unit + b)
        if logistic:
            loss, slope = np.logaddexp(0.0, -z), -1 / (1 + np.exp(np.minimum(z, 700.0)))
        else:
            miss = np.maximum(0.0, 1 - z)
            loss, slope = miss * miss, -2 * miss
        sums[:width] += (weight * loss).sum(0)
        slope *= weight * y
        sums[width : 2 * width] += slope.sum(0)
        block.add_to(sums[2 * width :].reshape(width, size), slope * unit)

    sums = _pass(made, size, width * (2 + size), (weights[:, :-1] * idf[of], weights[:, -1]), work)
    gradient = np.empty_like(weights)
    gradient[:, :-1] = sums[2 * width :].reshape(width, size) * idf[of] + weights[:, :-1]
    gradient[:, -1] = sums[width : 2 * width] + (0 if logistic else weights[:, -1])
    own = weights[:, :-1] if logistic else weights
    return sums[:width] + (own * own).sum(1) / 2, gradient


def directions(made: DataFrame, idf: np.ndarray, problems: list[Problem], most: int = DIRECTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The directions in which rows reach furthest, b among the places, their squares summed there, and each problem's mean cost.

    A few of these have thousands of times the curvature of all others.  They come from passes over all rows under the first vocabulary,
    and only say where a search should be short: what is found does not depend on them.
    """
    cost, size = [p.cost for p in problems], idf.shape[1]
    width = min(most, size + 1)

    def work(block: _Block, shared: tuple[np.ndarray, np.ndarray], sums: np.ndarray) -> None:
        w, b = shared
        unit = block.unit[:, :1]
        reach = block.times(w) * unit + b
        sums[:width] += reach.sum(0)
        sums[width] += block.n
        sums[width + 1 : width + 1 + len(cost)] += block.cost[:, cost].sum(0)
        block.add_to(sums[width + 1 + len(cost) :].reshape(width, size), reach * unit)

    found = np.random.default_rng(0).normal(size=(width, size + 1))
    for _ in range(3):
        basis = np.linalg.qr(found.T)[0].T
        sums = _pass(made, size, width * (1 + size) + 1 + len(cost), (basis[:, :-1] * idf[0], basis[:, -1].copy()), work)
        found = np.concatenate([sums[width + 1 + len(cost) :].reshape(width, size) * idf[0], sums[:width, None]], 1)
    squares, turn = np.linalg.eigh(basis @ found.T)
    return turn.T @ basis, np.maximum(squares, 0.0), sums[width + 1 : width + 1 + len(cost)] / max(1.0, sums[width])


def solve(made: DataFrame, idf: np.ndarray, problems: list[Problem], logistic: bool = False, gap: float = GAP, passes: int = PASSES) -> np.ndarray:
    """Weights and b of each problem."""
    ways, squares, costs = directions(made, idf, problems)
    bent = np.stack([p.c * k * squares * (0.2 if logistic else 1.2) for p, k in zip(problems, costs)])  # about, at the least point

    def shorten(p: int, x: np.ndarray) -> np.ndarray:
        return x - ((bent[p] / (1 + bent[p])) * (ways @ x)) @ ways

    start = np.zeros((len(problems), idf.shape[1] + 1))
    return minimise(lambda x, which: objective(made, idf, [problems[p] for p in which], x, logistic), start, gap, passes, shorten)


def class_sums(made: DataFrame, idf: np.ndarray, problems: list[Problem]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows, problems by two, and sums of the rows' vectors, problems by two by places: of target -1 and of target 1, where the cost is not 0."""
    of, target, cost = [p.vocabulary for p in problems], [p.target for p in problems], [p.cost for p in problems]
    size, width = idf.shape[1], len(problems)

    def work(block: _Block, _: object, sums: np.ndarray) -> None:
        there, y = block.cost[:, cost] != 0, block.target[:, target]
        sides = np.stack([there & (y < 0), there & (y > 0)], 2).astype(float)
        sums[: 2 * width] += sides.sum(0).reshape(-1)
        block.add_to(sums[2 * width :].reshape(2 * width, size), (sides * block.unit[:, of][:, :, None]).reshape(block.n, -1))

    sums = _pass(made, size, 2 * width * (1 + size), None, work)
    return sums[: 2 * width].reshape(width, 2), sums[2 * width :].reshape(width, 2, size) * idf[of][:, None]


def outcomes(made: DataFrame, idf: np.ndarray, problems: list[Problem], weights: np.ndarray) -> np.ndarray:
    """Rows by problem, by cost not 0, by target above 0 and by margin above 0."""
    of, target, cost = [p.vocabulary for p in problems], [p.target for p in problems], [p.cost for p in problems]
    width = len(problems)

    def work(block: _Block, shared: tuple[np.ndarray, np.ndarray], sums: np.ndarray) -> None:
        w, b = shared
        cell = 4 * (block.cost[:, cost] != 0) + 2 * (block.target[:, target] > 0) + (block.times(w) * block.unit[:, of] + b > 0)
        sums += np.bincount((cell + 8 * np.arange(width)).reshape(-1), minlength=8 * width)

    return _pass(made, idf.shape[1], 8 * width, (weights[:, :-1] * idf[of], weights[:, -1]), work).astype(np.int64).reshape(width, 2, 2, 2)


def minimise(value: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, gap: float = GAP, passes: int = PASSES, shorten: Callable[[int, np.ndarray], np.ndarray] = lambda p, x: x) -> np.ndarray:
    """Least points of several functions that are 1-strongly convex; ``value(x, which)`` gives values and gradients of the functions ``which``.

    ``shorten(p, x)`` applies about the inverse of the second derivatives of function p, from which its search starts.
    """
    x = start.copy()
    which = np.arange(len(x))
    f, g = value(x, which)
    past = [deque(maxlen=MEMORY) for _ in x]
    way = np.stack([-shorten(p, g[p]) for p in range(len(x))])
    step = 1 / np.maximum(1.0, np.sqrt((way * way).sum(1)))
    for _ in range(passes):
        open_ = [p for p in which if (g[p] @ g[p]) / 2 > gap * f[p]]  # f - least f <= |g|^2 / 2
        for p in set(which) - set(open_):
            past[p].clear()
        which = np.array(open_, int)
        if not len(which):
            break
        there = x[which] + step[which, None] * way[which]
        new_f, new_g = value(there, which)
        for k, p in enumerate(which):
            slope = g[p] @ way[p]
            if new_f[k] > f[p] + 1e-4 * step[p] * slope:
                # The least point of the parabola through what is known.
                step[p] *= min(0.5, max(0.05, -slope * step[p] / (2 * (new_f[k] - f[p] - step[p] * slope))))
                continue
            s, y = there[k] - x[p], new_g[k] - g[p]
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                past[p].append((s, y, 1 / (s @ y)))
            x[p], f[p], g[p], step[p] = there[k], new_f[k], new_g[k], 1.0
            q, used = g[p].copy(), []
            for s, y, r in reversed(past[p]):
                a = r * (s @ q)
                used.append(a)
                q -= a * y
            q = shorten(p, q)
            if past[p]:
                s, y, r = past[p][-1]
                q *= (s @ y) / (y @ shorten(p, y))
            for (s, y, r), a in zip(past[p], reversed(used)):
                q += (a - r * (y @ q)) * s
            way[p] = -q
    return x


@dataclass
class MarginModel:
    """Terms with their idf, and for each problem a weight a term and b."""

    terms: list[str]
    idf: list[float]
    weights: np.ndarray

    def margins(self, rows: DataFrame, out: str = "margins") -> DataFrame:
        """``rows`` with an array of margins, one for each problem."""
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)

        @F.arrow_udf("array<double>")
        def of(column: pa.Array) -> pa.Array:
            w, (row, at, x), n = shared.value, _sparse(column), len(column)
            made = np.stack([np.bincount(row, x * w[p][at], n) + w[p, -1] for p in range(len(w))], 1)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(w)), pa.array(made.reshape(-1)))

        return rows.withColumn(out, of(encoder(rows.sparkSession, self.terms, self.idf)("terms")))

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with margin and prediction of the first problem."""
        return self.margins(rows).withColumn("margin", F.get("margins", F.lit(0))).withColumn("prediction", (F.col("margin") > 0).cast("double")).drop("margins")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t, float(d), [float(x) for x in self.weights[:, i]]) for i, (t, d) in enumerate(zip(self.terms, self.idf))]
        rows.append((len(rows), None, None, [float(x) for x in self.weights[:, -1]]))
        spark.createDataFrame(rows, "place int, term string, idf double, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)  # the vocabulary

    @staticmethod
    def load(spark: SparkSession, path: str) -> MarginModel:
        rows = spark.read.parquet(path).orderBy("place").collect()
        return MarginModel([r.term for r in rows[:-1]], [r.idf for r in rows[:-1]], np.array([r.weights for r in rows]).T)


def fit(rows: DataFrame, targets: list[Column], costs: list[Column], vocabulary: tuple[list[str], list[float]], c: float = 1.0, gap: float = GAP, passes: int = PASSES) -> MarginModel:
    """One model for each problem: ``rows`` has terms; targets are 1 or -1, costs 0 where a row takes no part."""
    names, idf = merged([vocabulary])
    made = blocks(rows, names, idf, targets, costs).persist()  # each pass reads it
    weights = solve(made, idf, [Problem(k, k, 0, c) for k in range(len(targets))], gap=gap, passes=passes)
    made.unpersist()
    return MarginModel(*vocabulary, weights)
