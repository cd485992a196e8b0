"""Ordered work over ranges: running sums, and the nearest key or the item at a place, with no group in one task.

Rows are dealt by ranges of (group, order); what a range needs of the ranges before or after it is one row of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut


def key_of(keys: Sequence[str]) -> F.Column:
    """The keys as one: inside a struct nulls equal each other."""
    return F.struct(F.lit(0).alias("all"), *keys).alias("__k")


def running_sums(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "before") -> DataFrame:
    """Adds, for each row, the sum of `value` over the rows of its group that come before it; `order` must tell rows of a
    group apart. Null values count as 0."""
    dealt = cut(df.withColumn("__k", key_of(keys)).repartitionByRange("__k", order).withColumn("__band", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    sums = dealt.groupBy("__k", "__band").agg(F.sum(v).alias("__sum"))  # a row for each range
    earlier = Window.partitionBy("__k").orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    skip = sums.select("__k", "__band", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__skip"))
    inside = F.coalesce(F.sum(v).over(Window.partitionBy("__k", "__band").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(name, inside).join(skip, ["__k", "__band"]).withColumn(name, F.col(name) + F.col("__skip")).drop("__k", "__band", "__skip")


def beside(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, after: bool = True) -> DataFrame:
    """Adds to rows the struct columns __before and, if asked for, __after: the mark of their group with the largest place at
    or before their own, and the one with the smallest behind it; null where there is none. marks(keys, at, mark) has one
    row for a place; places of both have one type, and rows without a place, or with a null one, get no mark."""
    names = rows.columns
    mine = rows.select(key_of(keys), F.col(at).alias("__at"), F.lit(1).alias("__tag"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), F.struct(*names).alias("__row"))
    theirs = marks.where(F.col(at).isNotNull()).select(key_of(keys), F.col(at).alias("__at"), F.lit(0).alias("__tag"), "mark", F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"))
    # a mark comes before the rows at its place
    dealt = cut(mine.unionByName(theirs).repartitionByRange("__k", "__at", "__tag").withColumn("__band", F.spark_partition_id()))
    held = F.when(F.col("mark").isNotNull(), F.struct(F.col("__at").alias("at"), "mark"))
    there = F.when(F.col("mark").isNotNull(), F.col("__at"))
    # field by field, which needs no sort where fields have fixed sizes
    fields = marks.schema["mark"].dataType.names if isinstance(marks.schema["mark"].dataType, T.StructType) else None

    def end(best, by):
        mark = by("mark", there) if fields is None else F.struct(*[by(F.col("mark")[f], there).alias(f) for f in fields])
        return F.when(best(there).isNotNull(), F.struct(best(there).alias("at"), mark.alias("mark")))

    ends = dealt.groupBy("__k", "__band").agg(end(F.max, F.max_by).alias("last"), *([end(F.min, F.min_by).alias("first")] if after else []))
    bands = Window.partitionBy("__k")
    beyond = (Window.unboundedPreceding, -1)
    carried = [F.last("last", True).over(bands.orderBy("__band").rowsBetween(*beyond)).alias("carried")]
    if after:
        carried.append(F.last("first", True).over(bands.orderBy(F.desc("__band")).rowsBetween(*beyond)).alias("coming"))
    ends = ends.select("__k", "__band", *carried)
    inside = Window.partitionBy("__k", "__band")
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("__before", F.last(held, True).over(inside.orderBy("__at", "__tag").rowsBetween(*up_to_here)))
    if after:
        out = out.withColumn("__after", F.last(held, True).over(inside.orderBy(F.desc("__at"), F.desc("__tag")).rowsBetween(*up_to_here)))
    out = out.where("__tag = 1").join(ends, ["__k", "__band"])
    some = F.col("__at").isNotNull()
    found = [F.when(some, F.coalesce("__before", "carried")).alias("__before")]
    if after:
        found.append(F.when(some, F.coalesce("__after", "coming")).alias("__after"))
    return out.select(*[F.col("__row")[n].alias(n) for n in names], *found)


def nearest_key(rows: DataFrame, layers: DataFrame, keys: Sequence[str], at: str, layer: str) -> DataFrame:
    """rows(keys, at, ...), layers(keys, at, layer) -> rows with the nearest layer of their group and `gap`, its distance; of
    two as near the one with the smaller `layer`. Rows of groups without layers, and rows without a place, get nulls."""
    marks = layers.where(F.col(layer).isNotNull()).groupBy(*keys, at).agg(F.min(layer).alias("mark"))
    both = beside(rows, marks, keys, at)
    end = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(at) - F.col(f"{c}.at")).alias("gap"), F.col(f"{c}.mark").alias("mark")))
    both = both.withColumn("__best", F.least(end("__before"), end("__after")))  # least passes over nulls
    return both.select(*rows.columns, F.col("__best.mark").alias(layer), F.col("__best.gap").alias("gap"))


def items_at(draws: DataFrame, items: DataFrame, keys: Sequence[str], item: str, weight: str, place: str = "place") -> DataFrame:
    """draws(keys, place, ...) -> draws with the item that holds their place: items of a group lie end to end in the order of
    `item`, each as long as its weight, a whole number, from place 0 on. Places beyond the end, and items of no weight, are
    left out. items(keys, item, weight)."""
    laid = running_sums(items.where(F.col(weight) > 0).select(*keys, item, weight), keys, item, weight, "__from")
    # written once: it would be worked out again for the ranges, and in few tasks beside the draws
    marks = cut(laid.select(*keys, F.col("__from").cast("long").alias(place), F.struct(item, (F.col("__from") + F.col(weight)).cast("long").alias("to")).alias("mark")))
    found = beside(draws, marks, keys, place, after=False)
    return found.where(F.col(place) < F.col("__before.mark.to")).select(*draws.columns, F.col(f"__before.mark.{item}").alias(item))
