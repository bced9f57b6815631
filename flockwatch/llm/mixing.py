"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are ordered by that
key, prefix sums of their sizes give each its stretch of the source's tokens, and the
source's budget is cut exactly where it ends, after as many whole epochs as it asks for.

Scale: the key's leading bits deal the documents of a source into ranges of about
`range_rows` rows, so one source with a third of all rows is spread over many tasks; the
sums of the ranges are summed by source first and added to what each range sums itself.
Statistics by source are a few numbers a source.

Defined results: a null text has size 0; a null source is a source of its own and comes
last; documents of size 0 are never taken; if all sizes are 0 all targets are 0; rows that
repeat share a key and are ordered by doc_id and size, equal rows being exchangeable.
Empty input gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, cut, row_key, take_rows, text_of

#: Weights go round the sources by code point.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows of a range, and ranges that are summed together first.
RANGE_ROWS, BLOCK = 1000, 1000
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def sizes(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words) and the hash-random key of each row, and columns `also`."""
    return docs.select(
        *also,
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{SEED}")).cast("binary")).alias("key"),
    )


def targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, rows, target: shares by weight, filled up to `most` times each source's size.

    Sources reach their limit in the order of limit by weight, so the level that all
    others share follows from running sums in that order.
    """
    code = F.encode(F.col("source"), "utf-32")
    placed = by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), code)) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    all_, before = Window.partitionBy(), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        placed.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(all_))
        .withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_weight") - F.col("full_weight")))
    )
    # the first source that its level doesn't fill sets the level of the rest
    fits = F.col("level") <= F.col("ratio")
    cut_at = F.min(F.when(fits, F.struct("ratio", "place", "level"))).over(all_)["level"]
    return level.select(
        "source", "source_size", "rows", F.least("limit", F.coalesce(cut_at * F.col("weight"), F.col("limit"))).alias("target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, range_rows: int = RANGE_ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and where the document's words start in its source."""
    rows = cut(sizes(docs, also))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goal = targets(by_source, weights, most).withColumn("ranges", F.ceil(F.col("rows") / range_rows)).drop("rows")
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    span = F.shiftright(head * F.col("ranges"), 32)
    dealt = (
        rows.alias("r")
        .join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .select(*also, "r.source", "doc_id", "size", "key", "source_size", "target", span.alias("range"))
    )
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    begin = F.col("offset") + F.col("inside")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - begin))
    return (
        summed.alias("s")
        .join(range_offsets(dealt).alias("o"), F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.range") == F.col("o.range")))
        .select(
            *also,
            "doc_id",
            "size",
            "source_size",
            "target",
            (epochs * F.col("size") + last).cast("long").alias("taken"),
            begin.cast("long").alias("begin"),
        )
    )


def range_offsets(dealt: DataFrame) -> DataFrame:
    """source, range, offset: the size of all earlier ranges, summed in two levels so that no task sees a whole source."""
    ranges = dealt.groupBy("source", "range").agg(F.sum("size").alias("size")).withColumn("block", F.floor(F.col("range") / BLOCK))
    blocks = ranges.groupBy("source", "block").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "block", "range", F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("inner"))
    return (
        ranges.alias("r")
        .join(blocks.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block")))
        .select("r.source", "r.range", (F.col("base") + F.col("inner")).alias("offset"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it.

    Documents stay whole: the one in each source where the budget ends is taken if at
    least half of it fits.
    """
    share = mix(docs.select("doc_id", "source", "text", row_key().alias(ROW_KEY)), also=(ROW_KEY,))
    copies = F.floor(F.col("taken") / F.col("size") + 0.5)
    times = share.where("size > 0").groupBy(ROW_KEY).agg(F.sum(copies).alias("_times")).where("_times > 0")
    return take_rows(docs, times, "_times")


ORACLE = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
         md5(coalesce(doc_id::varchar, 'null') || ':{SEED}') as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select source, source_size,
         case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         row_number() over (order by source is null, source) as place from s),
r as (
  select *, 3.0::double * source_size as lim, 3.0::double * source_size / weight as ratio,
         sum(source_size) over ()::double as total, sum(weight) over () as all_weight from w),
l as (
  select *, (total - coalesce(sum(lim) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0))
         / (all_weight - coalesce(sum(weight) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0)) as level from r),
g as (
  select source, source_size,
         least(lim, coalesce((select level from l where level <= ratio order by ratio, place limit 1) * weight, lim)) as target from l),
p as (
  select d.doc_id, d.size, g.source_size, g.target,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as begin
  from d join g on d.source is not distinct from g.source),
e as (select *, floor(target)::bigint as budget, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - begin)))::bigint as taken, begin
from e
"""
