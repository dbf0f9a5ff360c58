"""Operator 8, sharding by a minimax contiguous partition (DataFrame operations only).

Documents with equal texts form one atomic group.  Groups are laid out in the order of the
MD5 digest of their text, and the smallest capacity is searched at which a greedy walk over
that order needs no more than ``n_shards`` shards; the walk at that capacity gives the cuts.

The order is never gathered.  The driver holds sums of digest ranges: 4,096 ranges first,
then 256 parts of each range in which a cut can still fall.  Taking a range as indivisible
bounds the capacity from above, taking it as divisible at will bounds it from below; both
bounds come from a binary search with a greedy check, and only ranges that a walk between the
two bounds can cut are opened further.  The search ends when the bounds meet, which is exact.
Every level is one aggregation over the groups and brings the sums of a few ranges per cut.

Rows: null text is the empty text (size 1).  Repeated rows are rows of their own in the same
group.  An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from revlake.llm.common import cell_digits, order_digest, written

FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 3, 2, 32


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), CRC-32 and group digest of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group_key"))


class _Ranges:
    """Ordered ranges of the key space with their sums; a range is (first key digits, sum, groups, largest group)."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.ends, total = [], 0
        for _, size, _ in self.rows:
            total += size
            self.ends.append(total)
        self.total = total

    def open(self, at: int) -> bool:
        return self.rows[at][2] > 1

    def walk(self, capacity: int, divisible: bool, n_shards: int) -> list[tuple[int, int]] | None:
        """Greedy cuts as (position, range it falls in), or None if the capacity does not do."""
        cuts, at = [], 0
        for _ in range(n_shards):
            if self.total - at <= capacity:
                return cuts
            target = at + capacity
            k = bisect_right(self.ends, target)  # the range the target falls in
            begin = self.ends[k - 1] if k else 0
            new = target if divisible and self.open(k) else begin
            if new <= at:
                return None
            cuts.append((new, k))
            at = new
        return cuts if at >= self.total else None

    def least(self, divisible: bool, n_shards: int) -> int:
        low, high = max(1, -(-self.total // n_shards)), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, divisible, n_shards) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def cuttable(self, low: int, high: int, n_shards: int) -> set[int]:
        """Open ranges in which a walk at a capacity from low to high can cut."""
        found: set[int] = set()
        first, last = 0, 0
        for _ in range(n_shards - 1):
            a = bisect_right(self.ends, first + low)
            b = bisect_right(self.ends, last + high)
            if a >= len(self.ends):
                break
            found.update(k for k in range(a, min(b, len(self.ends) - 1) + 1) if self.open(k))
            first, last = (self.ends[a - 1] if a else 0), min(self.total, last + high)
        return found


def boundaries(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """Smallest feasible capacity, and for shards 1.. the first group key each begins at.

    ``groups`` has one row per group: group_key, size.
    """

    def summed(df: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        part = df.groupBy(F.substring("group_key", 1, digits).alias("k")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        return [(r.k, r.s, r.n) for r in part.collect()]

    ranges = _Ranges(summed(groups, FIRST_DIGITS))
    digits = FIRST_DIGITS
    while True:
        low, high = ranges.least(True, n_shards), ranges.least(False, n_shards)
        opened = ranges.cuttable(low, high, n_shards) if ranges.rows else set()
        if not opened or digits >= ALL_DIGITS:
            break
        prefixes = {ranges.rows[k][0] for k in opened}
        digits += MORE_DIGITS
        within = [F.col("group_key").startswith(p) for p in sorted(prefixes)]
        any_of = within[0]
        for x in within[1:]:
            any_of = any_of | x
        finer = summed(groups.filter(any_of), digits)
        ranges = _Ranges([r for r in ranges.rows if r[0] not in prefixes] + finer)
    cuts = ranges.walk(high, False, n_shards) or []
    return high, [ranges.rows[k][0] for _, k in cuts]


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is ``bytes``: shard sizes are as even as whole groups in their order allow.
    ``slot`` counts the rows of a shard from 0 without gaps, in the order of a digest of id and
    text: rows are numbered inside cells, which are the first digits of that digest, and each
    cell begins after the rows of the cells before it.  The number of cells grows with the
    rows, so that no task holds a shard, whatever the ids.  ``grown_shard`` belongs to another law and is null.
    """
    rows = written(measured(docs), "sharding-rows")
    total = rows.count()
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("size"))
    _, cuts = boundaries(written(groups, "sharding-groups"), n_shards)
    placed = F.lit(0)
    for key in cuts:
        placed = placed + F.when(F.col("group_key") >= key, 1).otherwise(0)
    rows = rows.withColumn("shard", placed.cast("int")).withColumn("digest", order_digest("doc_id", "group_key"))
    rows = rows.withColumn("cell", F.substring("digest", 1, cell_digits(total)))
    counted = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row per cell of a shard
    inside = Window.partitionBy("shard", "cell").orderBy("digest")
    return (
        rows.join(offsets, ["shard", "cell"])
        .withColumn("slot", (F.col("offset") + F.row_number().over(inside) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
    )


#: DuckDB: the smallest capacity by dynamic programming over all contiguous partitions, then the greedy cuts.
_CRC = """
crc_table as (select list(v order by i) as crc from (
  select i, list_reduce(list_prepend(i::bigint, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
  from range(256) r(i)))"""


def oracle_sql(n_shards: int = 8) -> str:
    steps = "".join(
        f", dp{k} as materialized (select j.i as i, min(greatest(d.v, j.p - d.p)) as v, any_value(j.p) as p from g j join dp{k - 1} d on d.i <= j.i group by j.i)" for k in range(2, n_shards + 1)
    )
    cuts = "".join(f", c{k} as materialized (select (select max(g.p) from g, cap where g.p <= c{k - 1}.p + cap.c) as p from c{k - 1})" for k in range(1, n_shards))
    shard_of = " + ".join(f"(q.p0 >= (select p from c{k}))::int" for k in range(1, n_shards))
    return f"""
with recursive {_CRC},
d as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, (octet_length(encode(t)) + 1)::bigint as size, md5(t) as k,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda a, b: xor(a >> 8, crc_table.crc[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32
  from d, crc_table),
gs as (select k, sum(size)::bigint as s from m group by k),
g as materialized (select 0 as i, 0::bigint as p union all select row_number() over (order by k), (sum(s) over (order by k))::bigint from gs),
q as (select k, (sum(s) over (order by k))::bigint - s as p0 from gs),
dp1 as materialized (select i, p as v, p from g){steps},
cap as (select v as c from dp{n_shards} order by i desc limit 1),
c0 as (select 0::bigint as p){cuts},
placed as (select m.doc_id, m.size, m.text_crc32, m.k, ({shard_of})::int as shard from m join q using (k))
select doc_id, size, text_crc32, 'bytes' as law, shard,
  (row_number() over (partition by shard order by md5(coalesce(doc_id::varchar, 'n') || '|' || k)) - 1)::bigint as slot,
  null::int as grown_shard
from placed"""
