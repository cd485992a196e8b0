"""Points: grid-binned radius joins, nearest distances, trims and cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .robust import quantiles

XYZ = ("x", "y", "z")


def within_radius(a: DataFrame, b: DataFrame, unit: Sequence[str], radius: str | float, anti: bool = False) -> DataFrame:
    """Rows of a that have (anti: don't have) a point of b of the same unit at `radius` or less, a number or a column of
    both sides that is fixed per unit.

    Space is cut into cells of the radius; each point of b is put into the 27 cells around it and points of a only into
    their own, so b should be the smaller side; points of it that repeat are dealt once. Rows of a in a crowded cell may
    be split over tasks, as Spark does with skewed semi and anti joins; each of these holds the cell's points of b."""
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else F.col(radius)
    cells = {f"c{k}": F.floor(F.col(k) / r) for k in XYZ}
    near = b.select(*unit, *[F.col(k).alias(f"b{k}") for k in XYZ], *[c.alias(n) for n, c in cells.items()]).distinct()
    near = around(near, list(cells))
    own = a.withColumns(cells)
    d2 = sum(((F.col(k) - F.col(f"b{k}")) * (F.col(k) - F.col(f"b{k}")) for k in XYZ), F.lit(0.0))
    own, near = own.alias("own"), near.alias("near")
    keys = [F.col(f"own.{c}") == F.col(f"near.{c}") for c in (*unit, *cells)]
    if not isinstance(radius, (int, float)):
        r = F.col(f"own.{radius}")
    on = d2 <= r * r
    for k in keys:
        on = k & on
    return own.join(near, on, "left_anti" if anti else "left_semi").drop(*cells)


def few_within_radius(a: DataFrame, b: DataFrame, unit: Sequence[str], radius: str | float, ids: Sequence[str]) -> DataFrame:
    """within_radius for an a that is the smaller side: its rows, which `ids` tell apart, are dealt into the 27 cells around
    them and b's stay in their own."""
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else F.col(radius)
    cells = {f"c{k}": F.floor(F.col(k) / r) for k in XYZ}
    near = around(a.withColumns(cells), list(cells)).alias("near")
    own = b.select(*unit, *[F.col(k).alias(f"b{k}") for k in XYZ], *[c.alias(n) for n, c in cells.items()]).alias("own")
    d2 = sum(((F.col(f"near.{k}") - F.col(f"own.b{k}")) * (F.col(f"near.{k}") - F.col(f"own.b{k}")) for k in XYZ), F.lit(0.0))
    r = r if isinstance(radius, (int, float)) else F.col(f"near.{radius}")
    on = d2 <= r * r
    for c in (*unit, *cells):
        on = (F.col(f"near.{c}") == F.col(f"own.{c}")) & on
    return near.join(own, on, "left_semi").drop(*cells).dropDuplicates(list(ids))


def cross_hits(a: DataFrame, b: DataFrame, unit: Sequence[str], mine: Sequence[str], theirs: Sequence[str], radius: float, few: bool = False) -> DataFrame:
    """a(unit, mine, x, y, z), b(unit, theirs, x, y, z) -> (unit, mine, theirs, n, hits): for each group of a and each group of
    b in its unit, how many points a's group has and how many of them have a point of b's group at `radius` or less. few:
    a is the smaller side.

    Points are counted by cells whose diagonal is under the radius: what shares a cell with a point of the other group is
    a hit without meeting it, so crowded cells cost as much as others. Only points in cells without one are dealt to the
    other's groups and meet points around them. Coordinates must be numbers; others are no hits."""
    unit, mine, theirs = list(unit), list(mine), list(theirs)
    size, small = radius * (0.999999 / 3**0.5), [f"s{k}" for k in XYZ]
    # what isn't finite has no cell
    cell = lambda df: df.withColumns({f"s{k}": F.when(F.abs(k) < 1e15 * size, F.floor(F.col(k) / size)) for k in XYZ})
    places = cut(cell(a.groupBy(*unit, *mine, *XYZ).agg(F.count(F.lit(1)).alias("n"))))
    cells = cut(places.groupBy(*unit, *mine, *small).agg(F.sum("n").alias("n")))
    there = cut(cell(b).select(*unit, *theirs, *small).distinct())
    groups = there.select(*unit, *theirs).distinct()
    keys = [*unit, *mine, *theirs]
    total = cells.groupBy(*unit, *mine).agg(F.sum("n").alias("n")).join(groups, unit)
    sure = cells.join(there, [*unit, *small]).select(*keys, F.col("n").alias("hits"))
    open_cells = cells.select(*unit, *small).distinct().join(groups, unit).join(there, [*unit, *theirs, *small], "left_anti")
    asked = places.join(open_cells, [*unit, *small]).select(*keys, *XYZ, "n")
    met = few_within_radius(asked, b, [*unit, *theirs], radius, [*keys, *XYZ]) if few else within_radius(asked, b, [*unit, *theirs], radius)
    hits = sure.unionByName(met.select(*keys, F.col("n").alias("hits"))).groupBy(*keys).agg(F.sum("hits").alias("hits"))
    return total.join(hits, keys, "left").select(*keys, "n", F.coalesce("hits", F.lit(0)).alias("hits"))


def pairs_within(a: DataFrame, b: DataFrame, unit: Sequence[str], radius: float) -> DataFrame:
    """(unit, a, b, dist): the pids of all points of a and b of one unit at `radius` or less, found in cells of the radius."""
    cell = lambda k: F.floor(F.col(k) / F.lit(float(radius)))
    own = a.select(*unit, F.col("pid").alias("a"), *[F.col(k).alias(f"a{k}") for k in XYZ], *[cell(k).alias(f"c{k}") for k in XYZ])
    near = b.select(*unit, F.col("pid").alias("b"), *[F.col(k).alias(f"b{k}") for k in XYZ], *[cell(k).alias(f"c{k}") for k in XYZ])
    near = around(near, [f"c{k}" for k in XYZ])
    d2 = sum(((F.col(f"a{k}") - F.col(f"b{k}")) * (F.col(f"a{k}") - F.col(f"b{k}")) for k in XYZ), F.lit(0.0))
    met = own.join(near, [*unit, *[f"c{k}" for k in XYZ]])
    return met.select(*unit, "a", "b", F.sqrt(d2).alias("dist")).where(F.col("dist") <= radius)


def bounds(df: DataFrame, unit: Sequence[str]) -> DataFrame:
    return df.groupBy(*unit).agg(*[f(k).alias(f"{n}_{k}") for k in XYZ for n, f in (("lo", F.min), ("hi", F.max))])


def boundary_trim(df: DataFrame, unit: Sequence[str], load: str, share: float = 0.02, combined: Sequence[str] = ()) -> DataFrame:
    """Rows away from the boundary: y at both ends for plain loads, x at both ends and y at the top for combined ones."""
    b = df.join(bounds(df, unit), list(unit))
    lo, hi, span = (lambda k: F.col(f"lo_{k}")), (lambda k: F.col(f"hi_{k}")), (lambda k: share * (F.col(f"hi_{k}") - F.col(f"lo_{k}")))
    both = lambda k: (F.col(k) > lo(k) + span(k)) & (F.col(k) < hi(k) - span(k))
    keep = F.when(F.col(load).isin(*combined), both("x") & (F.col("y") < hi("y") - span("y"))).otherwise(both("y"))
    return b.where(keep).drop(*[f"{n}_{k}" for k in XYZ for n in ("lo", "hi")])


def percentile_cut(df: DataFrame, unit: Sequence[str], value: str, share: float) -> DataFrame:
    """Rows at or over the exact linear percentile of their unit."""
    cut = quantiles(df, unit, value, {"__cut": share})
    joined = df.join(cut, list(unit)) if unit else df.join(F.broadcast(cut))
    return joined.where(F.col(value) >= F.col("__cut")).drop("__cut")


def top_share(df: DataFrame, unit: Sequence[str], value: str, share: float, least: int, tie: str) -> DataFrame:
    """Rows at or over the percentile 1 - share of their unit; where these are fewer than `least`, the `least` largest rows.

    Only units with fewer rows over their cut than `least` are ranked; the ranks below `least` are cut off early."""
    kept = percentile_cut(df, unit, value, 1 - share)
    small = df.select(*unit).distinct().join(kept.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least), list(unit), "left_anti")
    w = Window.partitionBy(*unit).orderBy(F.desc(value), tie)
    ranked = df.join(small, list(unit), "left_semi").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= least).drop("__r")
    return kept.join(small, list(unit), "left_anti").unionByName(ranked)


def prf(tp_a: Column, n_a: Column, tp_b: Column, n_b: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of counts; 0 where a count is 0."""
    p = F.when(n_a > 0, tp_a / n_a).otherwise(0.0)
    r = F.when(n_b > 0, tp_b / n_b).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def square_to(q: str, t: str) -> Column:
    return sum(((F.col(f"{q}{k}") - F.col(f"{t}{k}")) * (F.col(f"{q}{k}") - F.col(f"{t}{k}")) for k in XYZ), F.lit(0.0))


def cell_widths(queries: DataFrame, targets: DataFrame, each: float = 3.0, crowded: float = 12.0) -> DataFrame:
    """queries(u, q, qx, qy, qz), targets(u, pid, x, y, z) -> (u, w, size) of units with targets: a cell's width and the
    diagonal of the box around all its points.

    A cell of the width holds `each` targets on the mean, were they even (a query then meets 27 times as many, and one in
    300,000 has none within the width); where they are crowded (the targets that queries find in their own cells are more
    than `crowded` for each query) the unit's width is halved, until they aren't. A flat box counts by the axes along
    which it has a size."""
    ends = [f(k).alias(f"{n}{k}") for k in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    box = targets.groupBy("u").agg(F.count(F.lit(1)).alias("n"), *ends)
    around_all = queries.select("u", *[F.col(f"q{k}").alias(k) for k in XYZ]).unionByName(targets.select("u", *XYZ)).groupBy("u").agg(*[(F.max(k) - F.min(k)).alias(f"s{k}") for k in XYZ])
    span = F.array(*[F.col(f"hi{k}") - F.col(f"lo{k}") for k in XYZ])
    wide = F.filter(span, lambda s: s > 1e-9 * F.array_max(span))
    mean = F.exp((F.aggregate(wide, F.lit(0.0), lambda a, s: a + F.log(s)) - F.log(F.col("n") / each)) / F.size(wide))
    size = F.sqrt(sum((F.col(f"s{k}") * F.col(f"s{k}") for k in XYZ), F.lit(0.0)))
    w = box.join(around_all, "u").select("u", F.when(F.array_max(span) > 0, mean).otherwise(F.greatest(size, F.lit(1e-9))).alias("w"), size.alias("size"))
    w = cut(w)
    least = F.greatest(F.col("size") * 1e-9, F.lit(1e-12))
    while True:
        cell = lambda p: [F.floor(F.col(f"{p}{k}") / F.col("w")).alias(f"c{k}") for k in XYZ]
        keys = ["u", "cx", "cy", "cz"]
        there = targets.join(w, "u").select("u", *cell("")).groupBy(*keys).agg(F.count(F.lit(1)).alias("nt"))
        asking = queries.join(w, "u").select("u", *cell("q")).groupBy(*keys).agg(F.count(F.lit(1)).alias("nq"))
        met = asking.join(there, keys).groupBy("u").agg(F.sum(F.col("nt").cast("double") * F.col("nq")).alias("met"))
        n = asking.groupBy("u").agg(F.sum("nq").alias("nq"))
        dense = (w.join(met, "u").join(n, "u").where((F.col("met") > crowded * F.col("nq")) & (F.col("w") > least)).select("u"))
        if dense.isEmpty():
            return w
        w = cut(w.join(dense.withColumn("dense", F.lit(True)), "u", "left").select("u", F.when(F.col("dense"), F.col("w") / 2).otherwise(F.col("w")).alias("w"), "size"))


def nearest(queries: DataFrame, targets: DataFrame, unit: str) -> DataFrame:
    """(unit, pid, dist): for each query point the distance to the nearest other target of its unit, null if there is
    none. Targets with the query's own pid don't count; pid must tell the queries of a unit apart.

    Cells are as wide as a unit's targets are dense (cell_widths), so that a query meets some tens of them at most in its own
    cell and those around it. What has none within a cell's width goes into the next round at twice the width, until that
    covers the unit; from the second round on queries meet the boxes of small cells first, and then only the points of
    those boxes that can hold the nearest one. No group is gathered, and targets at one place count as two at most."""
    q = cut(queries.select(F.col(unit).alias("u"), F.col("pid").alias("q"), *[F.col(k).alias(f"q{k}") for k in XYZ]))
    ends = [F.min("pid").alias("a"), F.max("pid").alias("b")]
    t = targets.groupBy(F.col(unit).alias("u"), *XYZ).agg(*ends).select("u", *XYZ, F.explode(F.array_distinct(F.array("a", "b"))).alias("pid"))
    t = cut(t.select("u", "pid", *XYZ))
    widths = cell_widths(q, t)
    left, found, first = q.join(widths, "u", "left").withColumn("dist", F.lit(None).cast("double")), None, True
    out = left.where("w is null").drop("w", "size")
    left = left.where("w is not null")
    while True:
        met = points_in_reach(left, t) if first else points_in_near_boxes(left, t)
        d2 = square_to("q", "")
        met = met.where(F.col("pid") != F.col("q")).withColumn("d2", d2).where(F.col("d2") <= F.col("w") * F.col("w"))
        near = met.groupBy("u", "q").agg(F.sqrt(F.min("d2")).alias("dist"))
        # who has met all of its unit is done, too
        done = cut(left.drop("dist").join(near, ["u", "q"], "left"))
        over = F.col("dist").isNotNull() | (F.col("w") > F.col("size"))
        out = out.unionByName(done.where(over).drop("w", "size"))
        left = done.where(~over).withColumn("w", F.least(2 * F.col("w"), F.col("size") * (1 + 1e-9) + 1e-12))
        if left.isEmpty():
            break
        first = False
    return out.select(F.col("u").alias(unit), F.col("q").alias("pid"), "dist")


def around(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Each row in the 27 cells around its own, to be joined by sorting: Spark takes the rows for as few as they were before
    and would send what is 27 times as large through the driver."""
    for c in cells:
        df = df.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    return df.hint("merge")


def widths_of(queries: DataFrame) -> DataFrame:
    return queries.select("u", "w").distinct()


def points_in_reach(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """queries(u, q, qx, qy, qz, w), targets(u, pid, x, y, z) -> pairs in neighbouring cells of the width w, fixed per unit."""
    cells = [f"c{k}" for k in XYZ]
    own = targets.join(widths_of(queries), "u")
    own = own.select(*targets.columns, *[F.floor(F.col(k) / F.col("w")).alias(f"c{k}") for k in XYZ])
    near = around(queries.select("*", *[F.floor(F.col(f"q{k}") / F.col("w")).alias(f"c{k}") for k in XYZ]), cells)
    return near.join(own, ["u", *cells])


def points_in_near_boxes(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The same pairs without targets that can't be the nearest: a quarter-cell's box of targets counts only if it begins no
    farther away than the box with the nearest end ends."""
    cells, fine = [f"c{k}" for k in XYZ], [f"f{k}" for k in XYZ]
    part = lambda k: F.floor(F.col(k) / (F.col("w") / 4))
    t = targets.join(widths_of(queries), "u").select(*targets.columns, *[part(k).alias(f"f{k}") for k in XYZ])
    ends = [f(k).alias(f"{n}{k}") for k in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = t.groupBy("u", *fine).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("one"), *ends)
    boxes = around(boxes.select("*", *[F.floor(F.col(f"f{k}") / 4).alias(f"c{k}") for k in XYZ]), cells)
    own = queries.select("*", *[F.floor(part(f"q{k}") / 4).alias(f"c{k}") for k in XYZ])
    gap = {k: F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"q{k}"), F.col(f"q{k}") - F.col(f"hi{k}")) for k in XYZ}
    far = {k: F.greatest(F.abs(F.col(f"q{k}") - F.col(f"lo{k}")), F.abs(F.col(f"q{k}") - F.col(f"hi{k}"))) for k in XYZ}
    square = lambda d: sum((d[k] * d[k] for k in XYZ), F.lit(0.0))
    # a box that holds nothing but the query itself is none
    met = own.join(boxes, ["u", *cells]).where((F.col("n") > 1) | (F.col("one") != F.col("q"))).select(*queries.columns, *fine, square(gap).alias("least"), square(far).alias("most"))
    met = cut(met)
    bound = met.groupBy("u", "q").agg((F.min("most") * (1 + 1e-9)).alias("bound"))
    close = met.join(bound, ["u", "q"]).where(F.col("least") <= F.col("bound")).drop("least", "most", "bound")
    return close.join(t, ["u", *fine])


def min_max(df: DataFrame, unit: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds value scaled to 0..1 in its unit, 0 where the unit is flat. Limits are aggregated and joined: no unit is
    gathered in a task."""
    limits = df.groupBy(*unit).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    return df.join(limits, list(unit)).withColumn(name, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)).drop("__lo", "__hi")
