"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node and an equality join.  The minimum is pre-aggregated; in the join
nodes with very many rows are matched by broadcast, so that no task holds a hub's rows.  Every
round is written to the shared folder; the driver sees a row count and a checksum only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import written

#: A key is a hub from so many rows on, and at least from a share of all rows that HUBS keys can have at most.
HUB_ROWS, HUBS = 100, 100_000


def join_hubs(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key and in ``n`` its number of rows, out of ``total``.

    Hubs, at most HUBS of them, are broadcast; all other keys are shuffled.  ``n`` is dropped.
    """
    bound = max(HUB_ROWS, total // HUBS)
    hubs = F.broadcast(table.filter(F.col(n) > bound).drop(n))
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(table.filter(F.col(n) <= bound).drop(n), key)
    return rows.join(hubs, key).unionByName(rest)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges (a, b) between long ids -> (id, root) for every id on an edge; root is the least id of its component."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = written(now, "edges")
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hubs(both.filter("v > u"), least, "u", "n", 2 * stamp[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # A node whose only neighbour is the least needs no join.
        several = join_hubs(large, least.filter("n > 1"), "u", "n", stamp[0])
        small = several.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        new = _stamp(now)
        if new == stamp:
            break
        stamp = new
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
