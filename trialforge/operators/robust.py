"""Exact order statistics on few, huge groups: ranks in bands, trimmed means, signed ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, bands: int | None = None) -> DataFrame:
    """(keys, value, same, below, total): for each distinct value of a group, how many rows have it, how many are
    smaller, and how many there are. Null values are left out; null keys are groups like any other.

    Values are counted first, in the only pass over df; the counts are dealt by ranges of (group, value) over `bands` tasks
    (as many as a shuffle has), so that a group with as many distinct values as rows is sorted by many tasks, and a range
    needs no more of those before it than their sums. Where the ranges end changes no result."""
    # inside a struct nulls equal each other, so that groups with null keys meet themselves
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("__all"), *keys).alias("__k"), F.col(value).alias("__v"))
    counted = rows.groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("same"))
    ranges = counted.repartitionByRange(bands, "__k", "__v") if bands else counted.repartitionByRange("__k", "__v")
    dealt = cut(ranges.withColumn("band", F.spark_partition_id()))
    sums = dealt.groupBy("__k", "band").agg(F.sum("same").alias("in_band"))  # a row for each range
    of = Window.partitionBy("__k")
    before = of.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__k", "band", F.coalesce(F.sum("in_band").over(before), F.lit(0)).alias("offset"), F.sum("in_band").over(of).alias("total"))
    inside = Window.partitionBy("__k", "band").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inside", F.coalesce(F.sum("same").over(inside), F.lit(0))).join(offsets, ["__k", "band"])
    return ranked.select(*[F.col("__k")[k].alias(k) for k in keys], F.col("__v").alias(value), "same", (F.col("inside") + F.col("offset")).alias("below"), "total")


def range_ranks(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank") -> DataFrame:
    """Adds each row's place in its group by an orderable column of any type, from 0; `order` must tell rows of a group apart.

    Rows are dealt by ranges of (keys, order), placed inside their range and moved up by the sizes of the ranges before:
    no task sorts a whole group."""
    dealt = cut(df.repartitionByRange(*keys, order).withColumn("__band", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "__band").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = Window.partitionBy(*keys).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    skip = sizes.select(*keys, "__band", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    place = F.row_number().over(Window.partitionBy(*keys, "__band").orderBy(order)) - 1
    return dealt.withColumn(name, place).join(skip, [*keys, "__band"]).withColumn(name, F.col(name) + F.col("__skip")).drop("__band", "__skip")


def _trimmed(value: str, share: float, where: Column | None = None, whole: int = 0) -> Column:
    """Of value_ranks' rows: the mean without int(share * n) rows at either end, of all where n is at most `whole`."""
    k = F.when(F.col("total") > whole, F.floor(F.lit(share) * F.col("total"))).otherwise(F.lit(0))
    used = F.greatest(F.lit(0), F.least(F.col("below") + F.col("same"), F.col("total") - k) - F.greatest(F.col("below"), k))
    used = used if where is None else F.when(where, used)
    return F.sum(F.col(value) * used) / F.sum(used)


def _quantile(value: str, share: float, where: Column | None = None) -> Column:
    """Of value_ranks' rows: the value at share * (n - 1), linear between two rows."""
    at = F.lit(share) * (F.col("total") - 1)
    where = F.lit(True) if where is None else where
    pick = lambda i: F.max(F.when(where & (F.col("below") <= i) & (i < F.col("below") + F.col("same")), F.col(value)))
    low, high = pick(F.floor(at)), pick(F.ceil(at))
    return low + (high - low) * F.max(F.when(where, at - F.floor(at)))


def summary(df: DataFrame, keys: Sequence[str], plain: dict[str, Column], quantiles: dict[str, tuple[str, float]], trimmed: dict[str, tuple[str, float]] | None = None, whole: int = 0) -> DataFrame:
    """(keys, names): aggregates, exact linear quantiles and trimmed means ((column, share) by name) of each group; nulls
    don't count. Trimmed means of `whole` rows or less are plain means.

    All columns are ranked in one go as (column, value) rows, so a group costs one ranking however many figures are
    asked of it, and no task holds all values of a group, as the built-in percentile does."""
    keys, trimmed = list(keys), trimmed or {}
    values = list(dict.fromkeys(v for v, _ in [*quantiles.values(), *trimmed.values()]))
    key = F.struct(F.lit(0).alias("__all"), *keys).alias("__k")
    out = df.groupBy(key).agg(*[c.alias(n) for n, c in plain.items()]) if plain else df.select(key).distinct()
    stacked = df.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)])).alias("x"))
    ranks = value_ranks(stacked.select("__k", "x.m", "x.v"), ["__k", "m"], "v")
    of = lambda v: F.col("m") == values.index(v)
    wide = ranks.groupBy("__k").agg(*[_quantile("v", q, of(v)).alias(n) for n, (v, q) in quantiles.items()], *[_trimmed("v", t, of(v), whole).alias(n) for n, (v, t) in trimmed.items()])
    names = [*plain, *quantiles, *trimmed]
    return out.join(wide, "__k", "left").select(*[F.col("__k")[k].alias(k) for k in keys], *names)


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.05, name: str = "trimmed") -> DataFrame:
    """(keys, name): the mean without int(share * n) rows at either end; nulls don't count."""
    return value_ranks(df, keys, value).groupBy(*keys).agg(_trimmed(value, share).alias(name))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], trim: dict[str, float] | None = None) -> DataFrame:
    """(keys, names): exact linear quantiles, and trimmed means by name and share; nulls don't count.

    From ranks, so that no task holds all values of a group, as the built-in percentile does. Groups without a value
    have no row, but where keys is empty there is always one."""
    r = value_ranks(df, keys, value)
    return r.groupBy(*keys).agg(*[_quantile(value, q).alias(n) for n, q in shares.items()], *[_trimmed(value, t).alias(n) for n, t in (trim or {}).items()])


def top_n(df: DataFrame, keys: Sequence[str], value: str, tie: str, n: DataFrame) -> DataFrame:
    """Rows of df among the n largest values of their group; n is a table (keys, n). Ties at the limit go by `tie`.

    Values over the limit are found from ranks; only rows that tie at the limit are ordered."""
    keys = list(keys)
    larger = F.col("total") - F.col("below") - F.col("same")
    r = value_ranks(df, keys, value).join(n, keys).where(larger < F.col("n"))
    r = r.select(*keys, value, (F.col("n") - larger).alias("__room"), (larger + F.col("same") > F.col("n")).alias("__tied"))
    rows = df.join(r, [*keys, value])
    place = F.row_number().over(Window.partitionBy(*keys, value).orderBy(tie))
    tied = rows.where("__tied").withColumn("__place", place).where("__place <= __room").drop("__place")
    return rows.where("not __tied").unionByName(tied).drop("__room", "__tied").select(*df.columns)


def leaderboard(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, vm_trimmed, vm_median, en_trimmed, en_median, cells_mean, cells_median) of trials."""
    df = cut(df.select(*keys, "vm", "en", "n_cells"))  # else what df rests on is worked out twice
    return summary(
        df, keys, {"n": F.count(F.lit(1)), "cells_mean": F.avg("n_cells")},
        {"vm_median": ("vm", 0.5), "en_median": ("en", 0.5), "cells_median": ("n_cells", 0.5)}, {"vm_trimmed": ("vm", 0.05), "en_trimmed": ("en", 0.05)},
    )


def signed_rank(diffs: DataFrame, keys: Sequence[str], diff: str = "d") -> DataFrame:
    """(keys, n, w_plus, w_minus, tie_term, z): Wilcoxon's signed ranks; zeros are dropped, ties get their average rank.
    z is null where the variance is 0."""
    d = diffs.where(F.col(diff) != 0).withColumn("abs_d", F.abs(diff))
    ranks = value_ranks(d, keys, "abs_d")
    signs = d.groupBy(*keys, "abs_d").agg(F.count_if(F.col(diff) > 0).alias("plus"), F.count_if(F.col(diff) < 0).alias("minus"))
    r = ranks.join(signs, [*keys, "abs_d"]).withColumn("rank", F.col("below") + (F.col("same") + 1) / 2)
    # a third power passes the longs from two million equal values on
    same = F.col("same").cast("decimal(13,0)")
    ties = same * same * same - same
    out = r.groupBy(*keys).agg(
        F.sum("same").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * F.col("minus")).alias("w_minus"), F.sum(ties).cast("double").alias("tie_term")
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    return out.withColumn("z", F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)))


def signed_rank_p(n: int, w_plus: float, tie_term: float, side: str = "two-sided") -> float | None:
    """p of a signed-rank result: exact for n <= 50 without ties, else normal with tie correction; null if degenerate."""
    if n == 0:
        return None
    if n <= 50 and tie_term == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for i in range(1, n + 1):
            for s in range(len(ways) - 1, i - 1, -1):
                ways[s] += ways[s - i]
        w, total = round(w_plus), 2**n
        less, greater = sum(ways[: w + 1]) / total, sum(ways[w:]) / total
    else:
        variance = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
        if variance <= 0:
            return None
        z = (w_plus - n * (n + 1) / 4) / math.sqrt(variance)
        less, greater = 0.5 * math.erfc(-z / math.sqrt(2)), 0.5 * math.erfc(z / math.sqrt(2))
    return {"less": less, "greater": greater, "two-sided": min(1.0, 2 * min(less, greater))}[side]


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): correlation of average ranks over rows that have both values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    for c in ("x", "y"):
        r = value_ranks(rows.select(*keys, c), keys, c).select(*keys, c, (F.col("below") + (F.col("same") + 1) / 2).alias(f"r{c}"))
        rows = rows.join(r, [*keys, c])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def paired(df: DataFrame, keys: Sequence[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """(keys, a, b, d): mean values of two sides per key and their difference, where both are there; one pass, no join."""
    g = df.where(F.col(side).isin(a, b)).groupBy(*keys).agg(F.avg(F.when(F.col(side) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(side) == b, F.col(value))).alias("b"))
    return g.where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
