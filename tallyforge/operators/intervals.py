"""Continuous periods and gaps of overlapping, nested or gapped intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """One row per key: the one with the greatest `order`; ties go to the greatest payload. Repeated rows vanish.

    An aggregate rather than a window: rows of one key combine before the shuffle, so a hot key stays small.
    Null order values sort lowest.
    """
    best = F.max(F.struct(*order, *payload)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in payload))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, is_open: str | None = None, chunk: str | None = None) -> DataFrame:
    """Rows (keys, kind, from_at, to_at, is_open): a 'period' for each maximal run of intervals that overlap or
    touch, and a 'gap' between neighbouring periods.

    `is_open` names a boolean column; a true value makes the interval endless whatever its end says, and its
    period has a null `to_at` and is_open true. Left out: no start; not open and no end; end before start. Null
    keys form one entity. Empty input gives no rows. Other columns are ignored, whatever they are called.

    Intervals are first combined per (keys, start), before and after the shuffle. For dates this bounds an
    entity by its days, however many rows it has. Timestamps have no such bound: give `chunk` (a date_trunc unit,
    e.g. 'month'), and the running maximum is taken per chunk, carried over from the chunk summaries.
    """
    shut = F.coalesce(F.col(start) > F.col(end), F.col(end).isNull())
    endless = F.coalesce(F.col(is_open), F.lit(False)) if is_open else F.lit(False)
    rows = (
        df.select(*keys, F.col(start).alias("__s"), F.when(~endless, F.col(end)).alias("__e"), endless.alias("__o"), shut.alias("__bad"))
        .filter(F.col("__s").isNotNull() & (F.col("__o") | ~F.col("__bad")))
        .groupBy(*keys, "__s")
        .agg(F.max("__e").alias("__e"), F.max("__o").alias("__o"))
    )
    if chunk is None:
        before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
        seen = rows.withColumns({"__pe": F.max("__e").over(before), "__po": F.max("__o").over(before)})
        island = F.sum(_opens_island()).over(upto)
        marked = seen.withColumn("__i", island)
    else:
        marked = _chunked_islands(rows, keys, chunk)
    spans = marked.groupBy(*keys, "__i").agg(F.min("__s").alias("__from"), F.max("__e").alias("__to"), F.max("__o").alias("__open"))
    spans = spans.withColumn("__next", F.lead("__from").over(Window.partitionBy(*keys).orderBy("__from")))
    period = F.struct(F.lit("period").alias("kind"), F.col("__from").alias("from_at"), F.when(~F.col("__open"), F.col("__to")).alias("to_at"), F.col("__open").alias("is_open"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("__to").alias("from_at"), F.col("__next").alias("to_at"), F.lit(False).alias("is_open"))
    out = spans.select(*keys, F.explode(F.when(F.col("__next").isNull(), F.array(period)).otherwise(F.array(period, gap))).alias("__x"))
    return out.select(*keys, "__x.kind", "__x.from_at", "__x.to_at", "__x.is_open")


def _opens_island():
    """1 where the start lies beyond everything seen before; needs __pe, __po, __s."""
    return F.when(F.coalesce(F.col("__po"), F.lit(False)), 0).when(F.col("__pe").isNull() | (F.col("__s") > F.col("__pe")), 1).otherwise(0)


def _chunked_islands(rows: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    rows = rows.withColumn("__c", F.date_trunc(chunk, F.col("__s").cast("timestamp")))
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "__c").agg(F.max("__e").alias("__ce"), F.max("__o").alias("__co"))
    carry = carry.select(*keys, "__c", F.max("__ce").over(earlier).alias("__ce"), F.max("__co").over(earlier).alias("__co"))
    same = lambda a, b: _all([a[k].eqNullSafe(b[k]) for k in [*keys, "__c"]])
    a, b = rows.alias("a"), carry.alias("b")
    joined = a.join(b, same(rows, carry), "left").select("a.*", "b.__ce", "b.__co")
    local = Window.partitionBy(*keys, "__c").orderBy("__s")
    before, upto = local.rowsBetween(Window.unboundedPreceding, -1), local.rowsBetween(Window.unboundedPreceding, 0)
    seen = joined.withColumns({"__pe": F.greatest(F.max("__e").over(before), F.col("__ce")), "__po": F.greatest(F.max("__o").over(before), F.col("__co"))})
    seen = seen.withColumn("__n", F.sum(_opens_island()).over(upto)).drop("__ce", "__co", "__pe", "__po")
    offset = seen.groupBy(*keys, "__c").agg(F.max("__n").alias("__off"))
    offset = offset.select(*keys, "__c", F.coalesce(F.sum("__off").over(earlier), F.lit(0)).alias("__off"))
    return seen.alias("a").join(offset.alias("b"), same(seen, offset), "left").select("a.*", (F.col("a.__n") + F.col("b.__off")).alias("__i"))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
