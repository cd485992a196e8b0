"""Which units are comparable: status filters, deduplication, complete-case and strict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = ["object", "load_case"]


def status_filter(df: DataFrame, mode: str = "ok") -> DataFrame:
    """mode: `ok` (exactly), `refined_or_not` (ok or ok_norefine), `prefix` (anything that begins with ok)."""
    s = F.col("status")
    return df.where({"ok": s == "ok", "refined_or_not": s.isin("ok", "ok_norefine"), "prefix": s.startswith("ok")}[mode])


def first_by(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) in the explicit order; a hash aggregate, no sort. order must tell rows apart."""
    pick = (F.max_by if last else F.min_by)(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("row")).select(*[F.col("row")[c].alias(c) for c in df.columns])


def complete_units(df: DataFrame, n_methods: int, unit: list[str] = UNIT, method: str = "method") -> DataFrame:
    """Units that have at least n_methods distinct methods."""
    return df.groupBy(*unit).agg(F.count_distinct(method).alias("n")).where(F.col("n") >= n_methods).drop("n")


def units_with_exactly(df: DataFrame, n_methods: int, unit: list[str] = UNIT, method: str = "method") -> DataFrame:
    """Units that have n_methods distinct methods, no more."""
    return df.groupBy(*unit).agg(F.count_distinct(method).alias("n")).where(F.col("n") == n_methods).drop("n")


def capped(df: DataFrame, sizes: DataFrame, on: list[str], size: str, most: float) -> DataFrame:
    """Rows whose size is known, over 0 and at most `most`; a missing size counts as infinite."""
    s = F.coalesce(size, F.lit(float("inf")))
    return df.join(sizes, on, "left").withColumn(size, s).where((F.col(size) > 0) & (F.col(size) <= most))


def units_with(df: DataFrame, needed: list[str], unit: list[str] = UNIT, method: str = "method") -> DataFrame:
    """Units that have all methods of a named set."""
    return complete_units(df.where(F.col(method).isin(*needed)), len(needed), unit, method)


def units_at_all_levels(df: DataFrame, methods: list[str], levels: list[float], unit: list[str] = UNIT) -> DataFrame:
    """Relational division: units that have each method at each level."""
    wanted = df.where(F.col("method").isin(*methods) & F.col("h_scale").isin(*levels))
    pairs = wanted.groupBy(*unit).agg(F.count_distinct(F.struct("method", "h_scale")).alias("n"))
    return pairs.where(F.col("n") == len(methods) * len(levels)).drop("n")


def strict_objects(units: DataFrame, n_loads: int) -> DataFrame:
    """Objects all of whose load cases are among the units."""
    return units.groupBy("object").agg(F.count_distinct("load_case").alias("n")).where(F.col("n") == n_loads).drop("n")


def sane_objects(df: DataFrame, oracle: Column, most: float, value: str = "vm") -> DataFrame:
    """Rows of objects none of whose oracle errors is over `most`."""
    return df.join(df.where(oracle & (F.col(value) > most)).select("object").distinct(), "object", "left_anti")


def sane_units(df: DataFrame, oracle: Column, most: float, value: str = "vm") -> DataFrame:
    """Rows of units whose least oracle error isn't over `most`; units without an oracle stay."""
    bad = df.where(oracle).groupBy(*UNIT).agg(F.min(value).alias("m")).where(F.col("m") > most).drop("m")
    return df.join(bad, UNIT, "left_anti")


def paired_valid_keys(df: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Keys that have two sides and no null on either, with how many there are of all keys."""
    g = df.groupBy(*keys).agg(F.count_distinct(side).alias("sides"), F.count_if(F.col(value).isNull()).alias("nulls"))
    return g.withColumn("valid", (F.col("sides") == 2) & (F.col("nulls") == 0))


def keep_units(df: DataFrame, units: DataFrame, on: list[str] = UNIT) -> DataFrame:
    return df.join(units, on, "left_semi")


def first_non_null(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """For each key the value of the first source that has one that isn't null."""
    both = None
    for i, s in enumerate(sources):
        part = s.where(F.col(value).isNotNull()).select(*keys, value, F.lit(i).alias("rank"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(*keys).agg(F.min_by(value, F.struct("rank", value)).alias(value))
