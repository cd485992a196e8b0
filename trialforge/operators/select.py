"""Selections whose order is their meaning: spread, farthest points, matching, suppression of similar views; and clusters.

They go in rounds of joins and aggregates, or of blocks, over all groups at once."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut
from .components import connected_components
from .robust import range_ranks
from .spatial import XYZ


SQUARE = lambda a, b: sum(((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in XYZ), F.lit(0.0))


#: Points of a unit up to which one task walks through it.
WALK = 1 << 16


class Walk:
    """Points of a unit met in order, of which those are kept that lie further than the radius from all kept before, `most` at
    most. Kept ones lie in cells twice the radius wide, of which each holds a few and eight can be near a point, so a point
    costs the same in any crowd; one that repeats an earlier one costs a look-up."""

    def __init__(self, radius: float | None, most: int | None):
        self.radius, self.most, self.kept = radius, most, 0
        self.cells: dict[int, list[tuple[float, float, float]]] = {}
        self.met: set[tuple[float, float, float]] = set()

    def meet(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> list[int]:
        """Which of the next points are kept."""
        room = len(x) if self.most is None else max(0, self.most - self.kept)
        out = list(range(min(len(x), room))) if self.radius is None else self._apart(np.stack((x, y, z)), room)
        self.kept += len(out)
        return out

    def _apart(self, p: np.ndarray, room: int) -> list[int]:
        out: list[int] = []
        cells, met, square, wide = self.cells, self.met, self.radius * self.radius, 2 * abs(self.radius) * 1.000001 or 1.0
        inside = np.isfinite(p).all(0)
        place = np.where(inside, p, 0.0) / wide
        own = np.floor(place)
        side = np.where(place - own < 0.5, -1, 1)
        own = own.astype(np.int64) if np.abs(own).max(initial=0) < 1 << 20 else np.frompyfunc(int, 1, 1)(own)
        # the own cell and those on the nearer side of each axis; different cells may share a number: distances tell
        near = np.zeros((8, p.shape[1]), own.dtype)
        for n, steps in enumerate(itertools.product((0, 1), repeat=3)):
            for k, (step, weight) in enumerate(zip(steps, (1 << 42, 1 << 21, 1), strict=True)):
                near[n] += (own[k] + step * side[k]) * weight
        for n, (at, ok, around) in enumerate(zip(zip(*p.tolist(), strict=True), inside.tolist(), near.T.tolist(), strict=True)):
            if len(out) >= room:
                break
            if ok:
                if at in met:
                    continue
                met.add(at)
                u, v, w = at
                for s in around:
                    for a, b, c in cells.get(s, ()):
                        if (u - a) * (u - a) + (v - b) * (v - b) + (w - c) * (w - c) <= square:
                            break
                    else:
                        continue
                    break
                else:
                    cells.setdefault(around[0], []).append(at)
                    out.append(n)
            else:
                out.append(n)
        return out


def first_apart(x: np.ndarray, y: np.ndarray, z: np.ndarray, radius: float | None, most: int | None) -> list[int]:
    """The points that are kept when they are met in order, as of Walk."""
    return Walk(radius, most).meet(x, y, z)


def spread(points: DataFrame, unit: Sequence[str], order: Sequence[Column], radius: str | float, most: DataFrame | None = None, walk: int = WALK) -> DataFrame:
    """The points that are kept when those of a unit are met in order, each that lies further than `radius` from all kept
    before, with seq, their number from 1. `radius` is a number or a column that is fixed per unit; `order` must tell the
    points of a unit apart. most(unit, n): a unit stops at n points; units that it lacks are not bounded.

    Units of up to `walk` points are dealt over the tasks, which walk through them as they come, sorted, batch by batch: one
    shuffle of the points' own columns, and work that grows with the points. A unit's limit comes as a row before its
    points. Larger units go in rounds (spread_in_rounds), so that no task walks through one."""
    unit, names = list(unit), points.columns
    fixed, bounded = float(radius) if isinstance(radius, (int, float)) else None, most is not None
    key = F.struct(F.lit(0).alias("all"), *unit).alias("__k")
    rows = cut(points)
    large = cut(rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > walk).select(key))
    some = not large.isEmpty()
    small = rows.select("*", key).join(large, "__k", "left_anti").select(*names) if some else rows
    place = F.row_number().over(Window.partitionBy(*unit).orderBy(*order))
    if bounded:
        types = {f.name: f.dataType for f in points.schema}
        limits = most.select(*[F.col(c).cast(types[c]).alias(c) if c in unit else F.lit(None).cast(types[c]).alias(c) for c in names], F.col("n").cast("long").alias("__most"), F.lit(True).alias("__limit"))
        small = small.withColumns({"__most": F.lit(None).cast("long"), "__limit": F.lit(False)}).unionByName(limits)
        place = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("__limit"), *order))
    asked = [F.col(k).cast("double").alias(f"__{k}") for k in XYZ] + ([F.col(radius).cast("double").alias("__r")] if fixed is None else [])
    small = small.select(*names, place.alias("__place"), *asked, *(["__most", "__limit"] if bounded else []))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Walk(fixed, None)
        for batch in batches:
            at, seq = [], []
            x, y, z = (batch.column(f"__{k}").to_numpy(zero_copy_only=False).astype(float) for k in XYZ)
            starts = np.flatnonzero(batch.column("__place").to_numpy() == 1).tolist()
            for a, b in itertools.pairwise([0, *starts, batch.num_rows]):
                if a == b:
                    continue
                if batch.column("__place")[a].as_py() == 1:
                    now, limit = Walk(fixed, None), bounded and batch.column("__limit")[a].as_py()
                    if limit:
                        now.most = batch.column("__most")[a].as_py()
                        a += 1
                        if a == b:
                            continue
                if now.kept == 0 and fixed is None:
                    now.radius = batch.column("__r")[a].as_py()
                found = now.meet(x[a:b], y[a:b], z[a:b])
                at += [a + i for i in found]
                seq += range(now.kept - len(found) + 1, now.kept + 1)
            if at:
                yield batch.select(names).take(pa.array(at, pa.int64())).append_column("seq", pa.array(seq, pa.int64()))

    out = small.mapInArrow(kept, T.StructType([*points.schema.fields, T.StructField("seq", T.LongType())]))
    return out.unionByName(spread_in_rounds(rows.select("*", key).join(large, "__k", "left_semi").select(*names), unit, order, radius, most)) if some else out


def spread_in_rounds(points: DataFrame, unit: Sequence[str], order: Sequence[Column], radius: str | float, most: DataFrame | None = None) -> DataFrame:
    """spread() of units of any size.

    In rounds: the first undecided point of each small cell (in which all points are neighbours) is kept if no undecided
    neighbour comes before it, and the neighbours of kept ones go. That keeps just what the walk in order does. A round
    costs a semi and an anti join on cells twice the radius wide, into which only those first points are dealt, up to
    eight times each; the number of rounds is that of the longest chain of ever later neighbours. Crowded cells are cheap:
    whatever lies in one, it has one candidate, and all else there goes with it."""
    unit = list(unit)
    fixed = isinstance(radius, (int, float))
    rows = cut(points.withColumns({"__k": F.struct(F.lit(0).alias("all"), *unit), "__o": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]), "__r": F.lit(float(radius)) if fixed else F.col(radius).cast("double")}))
    small, wide = [f"s{k}" for k in XYZ], [f"w{k}" for k in XYZ]
    r = F.col("__r")
    place = rows.select("__k", "__o", "__r", *[F.col(k).alias(f"p{k}") for k in XYZ])
    # a little less than the widest cell whose diagonal is the radius
    place = place.select("*", *[F.floor(F.col(f"p{k}") / (r * (0.999999 / 3**0.5))).alias(f"s{k}") for k in XYZ], *[F.floor(F.col(f"p{k}") / (2 * r)).alias(f"w{k}") for k in XYZ])

    def dealt(heads: DataFrame) -> DataFrame:
        """Heads in all wide cells that their neighbourhood touches."""
        h = heads.select("__k", F.col("head.__o").alias("head"), *[F.col(f"head.p{k}").alias(f"h{k}") for k in XYZ], F.col("head.__r").alias("__r"))
        for k in XYZ:
            ends = [F.floor((F.col(f"h{k}") + side * r * 1.000001) / (2 * r)) for side in (-1, 1)]
            h = h.withColumn(f"w{k}", F.explode(F.sequence(*ends)))
        return h.drop("__r")

    left, kept = cut(place), None
    while not left.isEmpty():
        heads = left.groupBy("__k", *small).agg(F.min(F.struct("__o", *[f"p{k}" for k in XYZ], "__r")).alias("head"))
        heads = heads.select("__k", "head")
        near = dealt(heads).alias("near")
        same = lambda of: [F.col(f"near.{c}") == F.col(f"{of}.{c}") for c in ("__k", *wide)]
        earlier = left.alias("q")
        on = (SQUARE("q.p", "near.h") <= F.col("q.__r") * F.col("q.__r")) & (F.col("q.__o") < F.col("near.head"))
        for c in same("q"):
            on = c & on
        beaten = near.join(earlier, on, "left_semi").select("__k", "head").distinct().withColumnRenamed("head", "beaten")
        won = cut(heads.alias("h").join(beaten.alias("b"), (F.col("h.__k") == F.col("b.__k")) & (F.col("h.head.__o") == F.col("b.beaten")), "left_anti"))
        reach = dealt(won).alias("near")
        on = SQUARE("q.p", "near.h") <= F.col("q.__r") * F.col("q.__r")
        for c in same("q"):
            on = c & on
        left = left.alias("q").join(reach, on, "left_anti")
        kept = won.select("__k", F.col("head.__o").alias("__o")) if kept is None else kept.unionByName(won.select("__k", F.col("head.__o").alias("__o")))
        left = cut(left)
        if most is not None:
            # units whose kept points before all undecided ones are enough are done
            first = left.groupBy("__k").agg(F.min("__o").alias("first"))
            full = kept.join(first, "__k").where("__o < first").groupBy("__k").agg(F.count(F.lit(1)).alias("have"))
            limit = most.select(F.struct(F.lit(0).alias("all"), *unit).alias("__k"), "n")
            left = cut(left.join(full.join(limit, "__k").where("have >= n"), "__k", "left_anti"))
    if kept is None:
        return points.withColumn("seq", F.lit(0).cast("long")).limit(0)
    # range_ranks numbers a unit over many tasks
    numbered = range_ranks(kept, ["__k"], "__o", "seq").withColumn("seq", (F.col("seq") + 1).cast("long"))
    if most is not None:
        limit = most.select(F.struct(F.lit(0).alias("all"), *unit).alias("__k"), "n")
        numbered = numbered.join(limit, "__k", "left").where("n is null or seq <= n").drop("n")
    return rows.join(numbered, ["__k", "__o"]).select(*points.columns, "seq")


def farthest(points: DataFrame, unit: Sequence[str], order: str, n: int) -> DataFrame:
    """Of each unit n points, with seq from 1: the first by `order`, then each time the one farthest from those before; ties go
    to the first by `order`, which must tell the points of a unit apart. Points that lie on chosen ones come last.

    All units take a step together: the points, in one table that stays as it is, meet the few chosen ones of their unit
    and one aggregate, partial in each task, finds the next. No task holds a unit, and n is the number of passes."""
    at = F.struct(*[F.col(k).cast("double").alias(k) for k in XYZ])
    rows = cut(points.select(F.struct(F.lit(0).alias("all"), *unit).alias("__k"), F.col(order).alias("__o"), at.alias("__p")))
    chosen = cut(rows.groupBy("__k").agg(F.min(F.struct("__o", "__p")).alias("c")).select("__k", F.array("c").alias("chosen")))
    d2 = lambda a, b: sum(((a[k] - b[k]) * (a[k] - b[k]) for k in XYZ), F.lit(0.0))
    for _ in range(n - 1):
        met = rows.join(chosen, "__k").where(~F.exists("chosen", lambda c: c["__o"] == F.col("__o")))
        met = met.withColumn("far", F.array_min(F.transform("chosen", lambda c: d2(c["__p"], F.col("__p")))))
        # of equal distances the first in order: the larger distance first, then the smaller order
        best = met.groupBy("__k").agg(F.min(F.struct((-F.col("far")).alias("near"), "__o", "__p")).alias("best"))
        grown = F.when(F.col("best").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array(F.struct("best.__o", "best.__p"))))
        chosen = cut(chosen.join(best, "__k", "left").select("__k", grown.alias("chosen")))
    picked = chosen.select("__k", F.posexplode("chosen").alias("seq", "c")).select("__k", F.col("c.__o").alias(order), (F.col("seq") + 1).cast("long").alias("seq"))
    keyed = points.withColumn("__k", F.struct(F.lit(0).alias("all"), *unit))
    return keyed.join(picked, ["__k", order]).select(*points.columns, "seq")


def touching_cells(cells: DataFrame, unit: str, axes: Sequence[str]) -> DataFrame:
    """cells(unit, axes as longs) -> (unit, axes, root): of each cell the smallest cell, by axes in order, of those that it is
    connected to by steps to neighbours, diagonal ones too. Each cell asks for half of its neighbours, by a join."""
    one = cells.select(unit, *axes).distinct()
    cell = F.struct(unit, *axes)
    ahead = [d for d in itertools.product((-1, 0, 1), repeat=len(axes)) if d > (0,) * len(axes)]
    asked = one.select(cell.alias("u"), F.explode(F.array(*[F.struct(unit, *[(F.col(a) + d).alias(a) for a, d in zip(axes, step, strict=True)]) for step in ahead])).alias("v"))
    edges = asked.join(one.select(cell.alias("v")), "v")
    found = connected_components(edges.select("u", "v"))
    return one.select(cell.alias("node")).join(found, "node", "left").select("node.*", F.coalesce("root", "node").alias("root"))


def density_clusters(pixels: DataFrame, unit: str, radius: float, least: int) -> DataFrame:
    """pixels(unit, px, py) -> (unit, px, py, cluster): clusters by density. A pixel with `least` pixels within the radius,
    itself included, is a core; cores within the radius of each other share a cluster, and other pixels within the radius
    of a core join that of its smallest cluster. cluster is the smallest core, by (px, py); noise has no row. Repeated
    pixels count once.

    Pairs come from cells as wide as the radius; pixels have whole coordinates, so a cell holds radius ** 2 of them at most
    and all joins grow with the pixels. Cores that share a cell half as wide (whose diagonal is under the radius) are one
    node of the graph whose components are the clusters."""
    p = cut(pixels.select(unit, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).distinct())
    grid = lambda k: F.floor(F.col(k) / F.lit(float(radius)))
    own = p.select("*", grid("px").alias("ci"), grid("py").alias("cj"))
    far = own.select(unit, F.col("px").alias("qx"), F.col("py").alias("qy"), "ci", "cj")
    for c in ("ci", "cj"):
        far = far.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    d2 = (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy"))
    pairs = cut(own.join(far, [unit, "ci", "cj"]).where(d2 <= radius * radius).select(unit, "px", "py", "qx", "qy"))
    cores = cut(pairs.groupBy(unit, "px", "py").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(unit, "px", "py"))
    of = cores.select(unit, F.col("px").alias("qx"), F.col("py").alias("qy"))
    near_core = pairs.join(of, [unit, "qx", "qy"], "left_semi")
    part = lambda x, y: F.struct(unit, *[F.floor(F.col(k) / (radius / 2)).alias(n) for k, n in ((x, "i"), (y, "j"))])
    links = near_core.join(cores, [unit, "px", "py"], "left_semi").select(part("px", "py").alias("u"), part("qx", "qy").alias("v"))
    roots = connected_components(links)
    held = cores.withColumn("node", part("px", "py")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = held.groupBy("root").agg(F.min(F.struct("px", "py")).alias("cluster"))
    held = cut(held.join(named, "root").select(unit, F.col("px").alias("qx"), F.col("py").alias("qy"), "cluster"))
    inner = held.select(unit, F.col("qx").alias("px"), F.col("qy").alias("py"), "cluster")
    border = near_core.join(cores, [unit, "px", "py"], "left_anti").join(held, [unit, "qx", "qy"]).groupBy(unit, "px", "py").agg(F.min("cluster").alias("cluster"))
    return inner.unionByName(border)


def closest_first(pairs: DataFrame, unit: str) -> DataFrame:
    """pairs(unit, a, b, dist) -> those that a one-to-one matching takes when it meets them by (dist, a, b).

    In each round the pairs that come first for both their ends are taken and what shares an end with them goes, which
    takes just what a walk in order would; a round costs two aggregates, and only long chains of ever nearer ends need
    many."""
    left, taken = cut(pairs), None
    while not left.isEmpty():
        first = lambda end, left=left: left.groupBy(unit, end).agg(F.min(F.struct("dist", "a", "b")).alias("first"))
        won = cut(first("a").select(unit, "first").join(first("b").select(unit, "first"), [unit, "first"]).select(unit, "first.*"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select(unit, "a"), [unit, "a"], "left_anti").join(won.select(unit, "b"), [unit, "b"], "left_anti"))
    return left.select(unit, "dist", "a", "b") if taken is None else taken


#: Rows of a group that a task meets one after another.
BLOCK = 4096

Vectors = Callable[[pd.DataFrame], np.ndarray]
Similar = Callable[[np.ndarray, np.ndarray], np.ndarray]


def first_unlike(x: np.ndarray, similar: Similar, last_only: bool, start: np.ndarray) -> list[int]:
    """The rows of x that are kept when they are met in order, start being the vectors kept before them."""
    kept, n, at = np.concatenate((start, np.zeros_like(x))), len(start), []
    for j in range(len(x)):
        against = kept[max(0, n - 1) : n] if last_only else kept[:n]
        if not n or not similar(against, x[j]).any():
            kept[n] = x[j]
            n += 1
            at.append(j)
    return at


def suppressed(df: DataFrame, key: str, order: Sequence[Column], vectors: Vectors, similar: Similar, last_only: bool = False) -> DataFrame:
    """Rows of each group that are kept when they are met in order, each that isn't similar to any kept before (last_only: to
    the last kept one), with seq. vectors(rows) gives a row's vector, similar(kept, x) tells for each kept one whether it
    is like x (or like each column of x). `order` must tell the rows of a group apart; null keys are a group.

    In rounds of blocks of BLOCK rows: all groups' blocks of one number are walked through, a task for each, and the rows
    that they keep are sent to all later blocks of their group, side by side in other tasks, to drop what is like them; so
    a task holds two blocks at most, however large a group is. With last_only nothing but a group's last kept row goes on
    to its next block. The number of rounds is that of the blocks of the largest group."""
    names = df.columns
    key_of_row = F.struct(F.lit(0).alias("all"), F.col(key)).alias("__k")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __rank long, __block long"
    rows = df.withColumns({"__k": key_of_row, "__o": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])})
    numbered = range_ranks(rows, ["__k"], "__o", "__rank").select(*names, F.col("__rank").cast("long").alias("__rank"), F.floor(F.col("__rank") / BLOCK).cast("long").alias("__block"))
    left = cut(numbered)
    last_block = left.agg(F.max("__block")).first()[0]

    def walk(now: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        now = now.sort_values("__rank", kind="stable").reset_index(drop=True)
        if not len(now):
            return now
        x = vectors(now)
        return now.iloc[first_unlike(x, similar, last_only, vectors(before) if len(before) else x[:0])]

    def drop(later: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(later) or not len(kept):
            return later
        return later[~similar(vectors(kept), vectors(later).T).any(0)]

    keyed = lambda t: t.withColumn("__k", key_of_row)
    kept = ends = left.limit(0)
    for b in range(0 if last_block is None else last_block + 1):
        now = keyed(left.where(F.col("__block") == b))
        won = cut(now.groupBy("__k").cogroup(keyed(ends).groupBy("__k")).applyInPandas(lambda x, y: walk(x[[*names, "__rank", "__block"]], y), schema))
        kept = won if b == 0 else kept.unionByName(won)
        if b == last_block:
            break
        if last_only:
            newest = keyed(ends.unionByName(won)).groupBy("__k").agg(F.max_by(F.struct(*names, "__rank", "__block"), "__rank").alias("r"))
            ends = cut(newest.select("r.*"))
            continue
        later = keyed(left.where(F.col("__block") > b))
        sent = keyed(won.drop("__block")).join(later.select("__k", F.col("__block").alias("__to")).distinct(), "__k")
        left = cut(later.groupBy("__k", "__block").cogroup(sent.groupBy("__k", "__to")).applyInPandas(lambda x, y: drop(x[[*names, "__rank", "__block"]], y), schema))
    out = range_ranks(keyed(kept), ["__k"], "__rank", "seq")
    return out.select(*names, (F.col("seq") + 1).cast("long").alias("seq"))


def hash_order(*columns: str, seed: int = 0):
    """A key of random order that any engine can repeat: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def sample_rows(df: DataFrame, columns: Sequence[str], size: DataFrame, seed: int = 0) -> DataFrame:
    """n rows of df, those that come first by hash_order of the columns (then by the columns); n is the only value of the
    one-row table `size`. The columns should tell rows apart: of rows that are equal in them some are taken.

    Hashes are even, so all that can be among the first n lies below a bound that is known from n and the number of rows,
    six standard deviations and more; only rows below it are ranked, over ranges. No limit runs in one task."""
    rows = df.withColumn("__h", hash_order(*columns, seed=seed))
    total, n = df.select(F.count(F.lit(1)).alias("total")).join(size.toDF("n")).first()
    n, spare = min(n or 0, total), 6.0
    if n <= 0:
        return df.limit(0)
    first = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    while True:
        bound = (n + spare * n**0.5 + spare) / total
        some = cut(rows.where(first < bound)) if bound < 1 else rows
        if bound >= 1 or some.count() >= n:
            break
        spare *= 4
    some = some.withColumn("__o", F.struct("__h", *columns))
    return range_ranks(some, [], "__o", "__rank").where(F.col("__rank") < n).select(*df.columns)
