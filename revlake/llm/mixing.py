"""Operator 10, mixing sources to target weights by systematic sampling (DataFrame operations only).

Targets.  Sources in code-point order, null last, weigh 5, 2, 1 and so on again.  They share
``budget`` times all sizes; no target exceeds ``most`` times its source's size, and what a
source cannot take is shared again by weight.  The fixed point is filled directly: sorted by
cap per weight, the sources whose cap is reached form a prefix, found with running sums.

Sampling.  Every document of a source expects ``target / source size`` copies.  Walking a
source in a fixed order, one random offset is added to the running sum of expected copies,
and a document is emitted once for each integer that its step crosses; as a step is at most
``most`` long, a document is emitted at most that often.  The order goes by size, so that each
size class is thinned alike and the taken words stay near the target.  The running sum is a
position times the rate: positions are counted within cells of a source (size class, and
first digits of a digest of id and text, more of them the more rows there are) plus the rows of
the cells before, so no task holds a source.  What a source's taken words miss the target by is
a few times its largest document at most.

Rows: null text has size 0.  Repeated rows are separate rows.  The null source is a source.
Empty tables give empty results.  Other columns of the input are ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.llm.common import WORD, cell_digits, order_digest, quoted, written

WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, budget: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size (one row per source) -> with target.  One row per source throughout."""
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*(F.lit(w) for w in weights))
    weighed = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    # Integers compare exactly: cap / w in lowest terms of the weights' product.
    product = 1
    for w in set(weights):
        product *= w
    order = [F.col("cap") * (F.lit(product) / F.col("w")).cast("long"), F.col("source").isNull(), F.col("source").cast("binary")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(budget) * F.col("all_size").cast("double") - F.col("caps_before").cast("double")) / (F.col("all_w") - F.col("w_before")).cast("double")
    filled = (
        weighed.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", level)
        .withColumn("reached", F.col("level") * F.col("w") > F.col("cap").cast("double"))
    )
    # The level of the first source whose cap is not reached holds for it and all after it.
    final = F.min(F.when(~F.col("reached"), F.struct(*order, F.col("level").alias("final_level")))).over(everything).getField("final_level")
    return filled.select("source", "source_size", F.when(F.col("reached"), F.col("cap").cast("double")).otherwise(F.least(final * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def offset(source: Column) -> Column:
    """The source's random offset in [0, 1): from the seed and its name alone, so reruns agree."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rows: DataFrame, most: int = 2, budget: float = 1.5) -> DataFrame:
    """Rows with doc_id, source, size and __tie, a digest of the text (and any others) -> source_size, target, copies added.

    The working columns begin with ``__``; the rows themselves are shuffled once.
    """
    summed = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(summed, budget, most)
    cell = F.struct(F.floor(F.log2(F.col("size") + 1) * 8).cast("int"), F.substring("__order", 1, cell_digits(rows.count())))
    celled = rows.withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("__order", order_digest("doc_id", "__tie")).withColumn("__cell", cell)
    counted = celled.groupBy("__src", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("__src", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__src", "__cell").orderBy("__order", "size")
    aimed = aims.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__src"), "source_size", "target", offset(F.col("source")).alias("__u"))
    cells = offsets.join(aimed, "__src")  # as many rows as cells
    placed = (
        celled.withColumn("__in", F.row_number().over(inside) - 1)
        .join(cells, ["__src", "__cell"])
        .withColumn("__at", (F.col("__before") + F.col("__in")).cast("double"))
        .withColumn("__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0))
    )
    crossed = F.floor(F.col("__u") + F.col("__rate") * (F.col("__at") + 1.0)) - F.floor(F.col("__u") + F.col("__rate") * F.col("__at"))
    return placed.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(most), crossed)).cast("long")).drop("__src", "__cell", "__order", "__before", "__in", "__u", "__at", "__rate")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("__tie"))
    out = copies(written(rows, "mixing-rows"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as the mix emits it, with the columns of ``docs``."""
    # Row numbers are written with the rows, so that both uses below see the same ones.
    tagged = docs.select(F.struct(*quoted(docs)).alias("__doc"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("__tie"), F.monotonically_increasing_id().alias("__row"))
    keyed = written(tagged, "mixing-documents")
    taken = copies(keyed.drop("__doc"))
    chosen = taken.filter("copies > 0").select("__row", "copies")
    out = keyed.select("__row", "__doc").join(chosen, "__row")
    return out.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__doc.*")


ORACLE_SQL = rf"""
with recursive d as (select doc_id, source, md5(coalesce(doc_id::varchar, 'n') || '|' || md5(coalesce(text, ''))) as o, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s as (select source, source_size, 2 * source_size as cap,
  ([5, 2, 1])[((row_number() over (order by source is null, encode(source)) - 1) % 3) + 1]::bigint as w from s0),
r(step, source, w, cap, capped, level) as (
  select 0, source, w, cap, false, (1.5::double * (select sum(source_size) from s)::double - 0::double) / (sum(w) over ())::double from s
  union all
  select step + 1, source, w, cap, now,
    (1.5::double * (select sum(source_size) from s)::double - (sum(case when now then cap else 0 end) over ())::double)
      / nullif((sum(case when now then 0 else w end) over ()), 0)::double
  from (select *, capped or level * w > cap::double as now from r where step < (select count(*) from s) + 1)),
t as (select source, case when capped then cap::double else least(level * w, cap::double) end as target from r where step = (select count(*) from s) + 1),
k as (select d.doc_id, d.size, s.source_size, t.target,
    case when s.source_size > 0 then t.target / s.source_size::double else 0::double end as rate,
    ('0x' || substr(md5('{SEED}:' || coalesce('s' || d.source, 'n')), 1, 8))::bigint::double / 4294967296::double as u,
    (row_number() over (partition by d.source order by floor(log2(d.size + 1) * 8), d.o) - 1)::double as pos
  from d join s on s.source is not distinct from d.source join t on t.source is not distinct from d.source),
c as (select *, greatest(0, least(2, floor(u + rate * (pos + 1)) - floor(u + rate * pos)))::bigint as copies from k)
select doc_id, size, source_size, target, copies * size as taken, copies from c"""
