"""Queries over points: cuts, radius matches, distances, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges as O
from ..operators import robust as R
from ..operators import select as K
from ..operators import spatial as S
from ..sources.tables import cut
from .registry import query

POINTS = """
select event_id as pid, event_type as grp, user_id % 5 as unit, cast(user_id % 100 as double) as x,
  (cast(floor(epoch(ts)) as bigint) % 86400) / 864.0e0 as y,
  cast(regexp_extract(props, '([0-9]+)', 1) as double) as z, value as val, 8.0e0 + user_id % 5 as r from events"""
GT = "select * from points where grp = 'error' and val >= (select quantile_cont(val, 0.9) from points where grp = 'error')"
ANCHORS = "select * from points where grp <> 'error'"
P = {"points": POINTS}
G = P | {"gt": GT, "anchors": ANCHORS}
D2 = "(a.x - g.x) * (a.x - g.x) + (a.y - g.y) * (a.y - g.y) + (a.z - g.z) * (a.z - g.z)"


def points(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    c = F.col
    seconds = F.unix_timestamp(c("ts").cast("timestamp"))
    return e.select(
        c("event_id").alias("pid"), c("user_id").alias("object"), c("event_type").alias("grp"), (c("user_id") % 5).alias("unit"), (c("user_id") % 100).cast("double").alias("x"),
        ((seconds % 86400) / 864.0).alias("y"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("z"), c("value").alias("val"), (8.0 + c("user_id") % 5).cast("double").alias("r"),
    )


def truth(p: DataFrame) -> DataFrame:
    return S.percentile_cut(p.where("grp = 'error'"), [], "val", 0.9)


def anchors(p: DataFrame) -> DataFrame:
    return p.where("grp <> 'error'")


def r6(x, name: str):
    return F.round(x, 6).alias(name)


@query("select unit, count(*) as n, round(sum(val), 4) as s from (select *, 'SP(' || cast(pid as varchar) as t from points) group by 1", **P)
def parse_points(spark, d):
    """Points written as scored-point text and read back."""
    from ..sources.files import parse_points as parse
    from ..sources.files import point_lines

    lines = points(spark, d).select(F.col("unit"), point_lines("x", "y", "z", "val").alias("value"))
    return parse(lines, "value").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 4).alias("s"))


@query("select pid, unit from (select *, min(y) over w as lo, max(y) over w as hi, min(x) over w as lx, max(x) over w as hx from points window w as (partition by unit)) where case when grp in ('view', 'signup') then x > lx + 0.02 * (hx - lx) and x < hx - 0.02 * (hx - lx) and y < hi - 0.02 * (hi - lo) else y > lo + 0.02 * (hi - lo) and y < hi - 0.02 * (hi - lo) end", **P)
def boundary_trim(spark, d):
    return S.boundary_trim(points(spark, d), ["unit"], "grp", 0.02, ["view", "signup"]).select("pid", "unit")


@query("select p.pid, p.unit from points p join (select unit, quantile_cont(val, 0.99) as c from points group by 1) using (unit) where val >= c", **P)
def percentile_cut(spark, d):
    return S.percentile_cut(points(spark, d), ["unit"], "val", 0.99).select("pid", "unit")


@query(f"select grp, count(*) as n, count(*) filter (where exists (select 1 from gt g where {D2} <= 100)) as hits from anchors a group by grp", **G)
def radius_match(spark, d):
    p = points(spark, d)
    a, hits = anchors(p), S.within_radius(anchors(p), truth(p), [], 10.0)
    n = a.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return n.join(hits.groupBy("grp").agg(F.count(F.lit(1)).alias("hits")), "grp", "left").fillna(0)


@query(f"select a.pid from anchors a where not exists (select 1 from gt g where g.unit = a.unit and {D2} <= a.r * a.r)", **G)
def radius_anti(spark, d):
    p = points(spark, d)
    return S.within_radius(anchors(p), truth(p), ["unit"], "r", anti=True).select("pid")


COUNTS = f"""select grp, unit, count(*) as n_a, count(*) filter (where exists (select 1 from gt g where g.unit = a.unit and {D2} <= a.r * a.r)) as m_a,
  (select count(*) from gt g where g.unit = a.unit) as n_g,
  (select count(*) from gt g where g.unit = a.unit and exists (select 1 from anchors b where b.grp = a.grp and b.unit = g.unit and (b.x - g.x) * (b.x - g.x) + (b.y - g.y) * (b.y - g.y) + (b.z - g.z) * (b.z - g.z) <= b.r * b.r)) as m_g
  from anchors a group by grp, unit"""


def match_counts(spark, d) -> DataFrame:
    """(grp, unit, n_a, m_a, n_g, m_g): anchors, those that match, hot points, those that are matched. Groups without a
    match stay."""
    p = cut(points(spark, d).select("pid", "grp", "unit", "x", "y", "z", "val", "r"))
    gt, a = cut(truth(p)), anchors(p)
    count = lambda df, keys, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    found_a = S.within_radius(a, gt, ["unit"], "r")
    # each group asks for all hot points of its unit, so hot points are dealt per group first
    per = gt.join(a.select("grp", "unit").distinct().withColumnRenamed("grp", "of"), "unit")
    found_g = S.few_within_radius(per.drop("grp").withColumnRenamed("of", "grp"), a, ["grp", "unit"], "r", ["grp", "unit", "pid"])
    out = count(a, ["grp", "unit"], "n_a").join(count(found_a, ["grp", "unit"], "m_a"), ["grp", "unit"], "left").join(count(gt, ["unit"], "n_g"), "unit", "left").join(count(found_g, ["grp", "unit"], "m_g"), ["grp", "unit"], "left")
    return out.fillna(0)


@query("select grp, p, r, case when p + r > 0 then round(2 * p * r / (p + r), 6) else 0 end as f1 from (select grp, round(sum(m_a) / sum(n_a), 6) as p, round(sum(m_g) / sum(n_g), 6) as r from counts group by 1)".replace("round(sum(m_a) / sum(n_a), 6)", "sum(m_a) / sum(n_a)").replace("round(sum(m_g) / sum(n_g), 6)", "sum(m_g) / sum(n_g)").replace("select grp, p, r, case", "select grp, round(p, 6) as p, round(r, 6) as r, case"), **G, counts=COUNTS)
def micro_prf(spark, d):
    s = match_counts(spark, d).groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("n_a", "m_a", "n_g", "m_g")])
    p, r, f = S.prf(F.col("m_a"), F.col("n_a"), F.col("m_g"), F.col("n_g"))
    return s.select("grp", r6(p, "p"), r6(r, "r"), r6(f, "f1"))


@query("select grp, count(*) as n, round(avg(p), 6) as p, round(avg(r), 6) as r, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 6) as f1 from (select grp, unit, m_a / n_a as p, case when n_g > 0 then m_g / n_g else 0 end as r from counts) group by 1", **G, counts=COUNTS)
def macro_prf(spark, d):
    p, r, f = S.prf(F.col("m_a"), F.col("n_a"), F.col("m_g"), F.col("n_g"))
    return match_counts(spark, d).select("grp", p.alias("p"), r.alias("r"), f.alias("f")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p"), "p"), r6(F.avg("r"), "r"), r6(F.avg("f"), "f1"))


@query(f"select grp, count(*) as n_crit, round(sum(val * z), 4) as energy, round(sum(z), 4) as volume, round(quantile_cont(val, 0.99), 6) as p99, max(val) as top from anchors a where exists (select 1 from gt g where g.unit = a.unit and {D2} <= a.r * a.r) group by 1", **G)
def region_qoi(spark, d):
    p = points(spark, d)
    hit = cut(S.within_radius(anchors(p), truth(p), ["unit"], "r").select("grp", "val", "z"))
    plain = {"n_crit": F.count(F.lit(1)), "energy": F.round(F.sum(F.col("val") * F.col("z")), 4), "volume": F.round(F.sum("z"), 4), "top": F.max("val")}
    return R.summary(hit, ["grp"], plain, {"p99": ("val", 0.99)}).withColumn("p99", F.round("p99", 6))


NEAR_A = f"select g.unit, g.pid, (select min(sqrt({D2})) from anchors a where a.unit = g.unit) as dist from gt g"


@query("select unit, count(*) as n, round(quantile_cont(dist, 0.5), 6) as median, round(quantile_cont(dist, 0.9), 6) as p90, round(max(dist), 6) as worst, round(avg(case when dist <= 4 then 1.0 else 0.0 end), 6) as within from near group by 1", **G, near=NEAR_A)
def coverage_distance(spark, d):
    p = points(spark, d)
    n = S.nearest(truth(p), anchors(p), "unit")
    plain = {"n": F.count(F.lit(1)), "worst": F.max("dist"), "within": F.avg(F.when(F.col("dist") <= 4, 1.0).otherwise(0.0))}
    s = R.summary(cut(n), ["unit"], plain, {"median": ("dist", 0.5), "p90": ("dist", 0.9)})
    return s.withColumns({c: F.round(c, 6) for c in ("worst", "within", "median", "p90")})


NEAR_G = f"select a.unit, a.pid, (select min(sqrt({D2})) from gt g where a.unit = g.unit) as dist from anchors a"


@query("select unit, round(f.a + b.a, 6) as chamfer, round((f.a + b.a) / 2, 6) as half, round(greatest(f.m, b.m), 6) as hausdorff from (select unit, avg(dist) as a, max(dist) as m from near group by 1) f join (select unit, avg(dist) as a, max(dist) as m from back group by 1) b using (unit)", **G, near=NEAR_A, back=NEAR_G)
def chamfer(spark, d):
    p = points(spark, d)
    gt, a = truth(p), anchors(p)
    f, b = (n.groupBy("unit").agg(F.avg("dist").alias(f"a{i}"), F.max("dist").alias(f"m{i}")) for i, n in enumerate((S.nearest(gt, a, "unit"), S.nearest(a, gt, "unit"))))
    return f.join(b, "unit").select("unit", r6(F.col("a0") + F.col("a1"), "chamfer"), r6((F.col("a0") + F.col("a1")) / 2, "half"), r6(F.greatest("m0", "m1"), "hausdorff"))


@query("select unit, round(case when n < 2 then 0.01 * diagonal else greatest(spacing, 0.001 * diagonal) end, 6) as spacing from (select unit, avg(dist) as spacing, count(*) as n from (select g.unit, (select min(sqrt((a.x - g.x) * (a.x - g.x) + (a.y - g.y) * (a.y - g.y) + (a.z - g.z) * (a.z - g.z))) from gt a where a.unit = g.unit and a.pid <> g.pid) as dist from gt g) group by 1) join (select unit, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) as diagonal from points group by 1) using (unit)", **G)
def nn_spacing(spark, d):
    """The mean distance to the nearest other point, at least a thousandth of the whole's diagonal; a hundredth of it for a single point."""
    p = points(spark, d)
    gt = truth(p)
    s = S.nearest(gt, gt, "unit").groupBy("unit").agg(F.avg("dist").alias("s"), F.count(F.lit(1)).alias("n"))
    size = F.sqrt(sum((F.pow(F.col(f"hi_{k}") - F.col(f"lo_{k}"), F.lit(2)) for k in S.XYZ), F.lit(0.0)))
    least = S.bounds(p, ["unit"]).select("unit", size.alias("diagonal"))
    return s.join(least, "unit").select("unit", r6(F.when(F.col("n") < 2, 0.01 * F.col("diagonal")).otherwise(F.greatest("s", 0.001 * F.col("diagonal"))), "spacing"))


LAYERS = "select unit, bin as layer, avg(y) as y from (select unit, y, cast(floor(y / 7.3) as bigint) as bin from points where grp = 'error') group by 1, 2"


@query("select pid, arg_min(layer, struct_pack(gap := gap, layer := layer)) as layer, round(min(gap), 6) as gap from (select p.pid, l.layer, abs(p.y - l.y) as gap from points p join layers l using (unit)) group by 1", **P, layers=LAYERS)
def nearest_layer(spark, d):
    """The nearest of each unit's layers, which lie at the mean heights of its hot points' bins: at no fixed pitch."""
    p = points(spark, d)
    layers = p.where("grp = 'error'").groupBy("unit", F.floor(F.col("y") / 7.3).cast("long").alias("layer")).agg(F.avg("y").alias("y"))
    return O.nearest_key(p.select("pid", "unit", "y"), layers, ["unit"], "y", "layer").select("pid", "layer", r6(F.col("gap"), "gap"))


@query("select pid, arg_min(layer, struct_pack(gap := gap, layer := layer)) as layer, min(gap) as gap from (select p.pid, l.layer, abs(p.s - l.s) as gap from (select event_id as pid, cast(floor(epoch(ts)) as bigint) % 86400 as s from events) p cross join (select layer, 2160 * layer + 360 * (layer % 3) as s from range(0, 41) t(layer)) l) group by 1")
def nearest_step(spark, d):
    """The nearest of 41 uneven steps in seconds of the day, for all points as one group: whole numbers, so that many points
    lie half way between two steps and get the first."""
    p = points(spark, d).select("pid", F.round(F.col("y") * 864).cast("long").alias("s"))
    steps = spark.range(41).select(F.col("id").alias("layer"), (2160 * F.col("id") + 360 * (F.col("id") % 3)).alias("s"))
    return O.nearest_key(p, steps, [], "s", "layer").select("pid", "layer", "gap")


@query("select unit, layer, count(*) as area, round(avg(x), 6) as cx, round(avg(z), 6) as cz, round(var_pop(z) * count(*), 4) as iz, round((var_pop(x) + var_pop(z)) * count(*), 4) as j from (select *, cast(floor(y / 10) as bigint) as layer from points) group by 1, 2", **P)
def section_properties(spark, d):
    n = F.count(F.lit(1))
    return points(spark, d).groupBy("unit", F.floor(F.col("y") / 10).cast("long").alias("layer")).agg(n.alias("area"), r6(F.avg("x"), "cx"), r6(F.avg("z"), "cz"), F.round(F.var_pop("z") * n, 4).alias("iz"), F.round((F.var_pop("x") + F.var_pop("z")) * n, 4).alias("j"))


SECTIONS = "select pid, unit, grp, 1.0 / a as c, abs(x - cx) / (iz + 1e-12) as b, sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)) / (j + 1e-12) as t from (select *, cast(floor(y / 10) as bigint) as layer from points) join (select unit, cast(floor(y / 10) as bigint) as layer, count(*) as a, avg(x) as cx, avg(z) as cz, var_pop(x) * count(*) as iz, (var_pop(x) + var_pop(z)) * count(*) as j from points group by 1, 2) using (unit, layer)"
NORMED = "select pid, unit, grp, " + ", ".join(f"coalesce(({k} - min({k}) over w) / nullif(max({k}) over w - min({k}) over w, 0), 0) as {k}" for k in "cbt") + " from sections window w as (partition by unit, grp)"
WEIGHT = "select pid, unit, grp, case grp when 'click' then c when 'error' then b when 'purchase' then t when 'view' then b + c else t + c end as w from normed"


@query("select pid, round(coalesce((w - min(w) over v) / nullif(max(w) over v - min(w) over v, 0), 0), 6) as weight from weights window v as (partition by unit, grp)", **P, sections=SECTIONS, normed=NORMED, weights=WEIGHT)
def nominal_stress_weight(spark, d):
    """Weights by load case from the sections: compression 1 / A, bending x / I, torsion r / J; those of the combined load
    cases are sums of normalised ones. All are normalised among the points of their unit and load case."""
    p = points(spark, d).withColumn("layer", F.floor(F.col("y") / 10))
    n = F.count(F.lit(1))
    s = p.groupBy("unit", "layer").agg(n.alias("a"), F.avg("x").alias("cx"), F.avg("z").alias("cz"), (F.var_pop("x") * n).alias("iz"), ((F.var_pop("x") + F.var_pop("z")) * n).alias("j"))
    dx, dz = F.col("x") - F.col("cx"), F.col("z") - F.col("cz")
    w = p.join(s, ["unit", "layer"]).select("pid", "unit", "grp", (1.0 / F.col("a")).alias("c"), (F.abs(dx) / (F.col("iz") + 1e-12)).alias("b"), (F.sqrt(dx * dx + dz * dz) / (F.col("j") + 1e-12)).alias("t"))
    for k in "cbt":
        w = S.min_max(w, ["unit", "grp"], k, k)
    c, b, t = (F.col(k) for k in "cbt")
    w = w.withColumn("w", F.when(F.col("grp") == "click", c).when(F.col("grp") == "error", b).when(F.col("grp") == "purchase", t).when(F.col("grp") == "view", b + c).otherwise(t + c))
    return S.min_max(w, ["unit", "grp"], "w", "weight").select("pid", r6(F.col("weight"), "weight"))


VOXEL = {k: f"least(9, cast(floor(({k} - l{k}) / (h{k} - l{k} + 1e-9) * 10) as bigint))" for k in "xyz"}


@query("select unit, i, j, k, n, heat, " + ", ".join(f"round(l{a} + ({c} + 0.5) / 10 * (h{a} - l{a}), 6) as c{a}" for a, c in zip("xyz", "ijk", strict=True)) + f" from (select unit, {VOXEL['x']} as i, {VOXEL['y']} as j, {VOXEL['z']} as k, count(*) as n, round(avg(val), 6) as heat, any_value(lx) as lx, any_value(hx) as hx, any_value(ly) as ly, any_value(hy) as hy, any_value(lz) as lz, any_value(hz) as hz from points join (select unit, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from points group by 1) using (unit) where val > 50 group by 1, 2, 3, 4)", **P)
def hotspot_voxels(spark, d):
    """Hot points by voxel of their unit's box, with the voxels' centres."""
    p = points(spark, d)
    b = p.join(S.bounds(p, ["unit"]), "unit")
    lo, size = (lambda a: F.col(f"lo_{a}")), (lambda a: F.col(f"hi_{a}") - F.col(f"lo_{a}"))
    cells = dict(zip("ijk", (F.least(F.lit(9), F.floor((F.col(a) - lo(a)) / (size(a) + 1e-9) * 10)).cast("long") for a in "xyz"), strict=True))
    ends = [F.first(f"{e}_{a}").alias(f"{e}_{a}") for a in "xyz" for e in ("lo", "hi")]
    v = b.where("val > 50").groupBy("unit", *[c.alias(k) for k, c in cells.items()]).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("val"), "heat"), *ends)
    return v.select("unit", "i", "j", "k", "n", "heat", *[r6(lo(a) + (F.col(c) + 0.5) / 10 * size(a), f"c{a}") for a, c in zip("xyz", "ijk", strict=True)])


@query("select distinct unit, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from points", **P)
def point_dedup(spark, d):
    return points(spark, d).select("unit", *[F.round(k, 4).alias(k) for k in "xyz"]).distinct()


@query("select pid from (select *, sum(case when inside then 1 else 0 end) over (partition by unit, grp) as n from (select *, y > min(y) over (partition by unit) + 2 * r and y < max(y) over (partition by unit) - 2 * r as inside from points)) where inside or n < 10", **P)
def band_exclusion(spark, d):
    p = points(spark, d)
    inside = (F.col("y") > F.col("lo_y") + 2 * F.col("r")) & (F.col("y") < F.col("hi_y") - 2 * F.col("r"))
    p = p.join(S.bounds(p, ["unit"]), "unit").withColumn("inside", inside)
    n = p.groupBy("unit", "grp").agg(F.count_if("inside").alias("n"))
    return p.join(n, ["unit", "grp"]).where("inside or n < 10").select("pid")


@query("select pid, round((val - min(val) over w) / (max(val) over w - min(val) over w), 6) as scaled from points window w as (partition by unit)", **P)
def minmax_normalise(spark, d):
    return S.min_max(points(spark, d), ["unit"], "val", "scaled").select("pid", r6(F.col("scaled"), "scaled"))


@query("select pid, unit from (select *, row_number() over (partition by unit order by val desc, pid) as place from points where grp <> 'error') join (select unit, count(*) as n from gt group by 1) using (unit) where place <= n", **G)
def topn_matched(spark, d):
    """As many anchors of each unit, the hottest first, as it has hot points."""
    p = points(spark, d)
    n = truth(p).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return R.top_n(anchors(p), ["unit"], "val", "pid", n).select("pid", "unit")


STEPS = [0.2 * k for k in range(1, 41)]
SCALED = "select least(1, greatest(0, (val - lo) / (hi - lo + 1e-9))) as s from points cross join (select min(val) as lo, max(val) as hi from points)"
TAIL = "select min(s) as cut from (select s, row_number() over (order by s desc) as r, count(*) over () as n from scaled) where r <= ceil(0.1 * n)"
POWERS = "select 0.2e0 * k as g, pow(s, 0.2e0 * k) as v, s >= cut as top from scaled cross join tail cross join range(1, 41) t(k)"
ENTROPY = "select g, -sum(h * ln(h)) as e from (select g, 100.0 * count(*) / sum(count(*)) over (partition by g) as h from (select g, least(99, floor(v * 100)) as b from powers) group by g, b) group by g"
EFFECT = "select g, (mt - mr) / (sqrt(((nt - 1) * vt + (nr - 1) * vr) / (nt + nr - 2) + 1e-12) + 1e-12) as d, v from (select g, var_pop(v) as v, avg(case when top then v end) as mt, avg(case when not top then v end) as mr, var_pop(case when top then v end) as vt, var_pop(case when not top then v end) as vr, count(*) filter (where top) as nt, count(*) filter (where not top) as nr from powers group by g)"


@query("select 'variance' as metric, round(arg_max(g, v), 6) as gamma, round(max(v), 6) as score from effects union all select 'effect', round(arg_max(g, d), 6), round(max(d), 6) from effects union all select 'entropy', round(arg_max(g, e), 6), round(max(e), 6) from entropies", **P, scaled=SCALED, tail=TAIL, powers=POWERS, entropies=ENTROPY, effects=EFFECT)
def contrast_gamma(spark, d):
    """The power of the scaled values with the most contrast: by variance, by the entropy of a histogram, and by the effect
    size between the upper tenth and the rest."""
    p = points(spark, d)
    ends = F.broadcast(p.agg(F.min("val").alias("lo"), F.max("val").alias("hi")))  # one row
    scaled = p.join(ends).select(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9))).alias("s"))
    counted = cut(R.value_ranks(scaled, [], "s"))  # equal values are raised to a power once
    above = F.col("total") - F.col("below")
    tail = F.broadcast(counted.where(above >= F.ceil(0.1 * F.col("total"))).agg(F.max("s").alias("cut")))
    powers = counted.join(tail).select("same", (F.col("s") >= F.col("cut")).alias("top"), "s", F.explode(F.array(*[F.lit(g) for g in STEPS])).alias("g")).withColumn("v", F.pow("s", "g"))
    bins = powers.groupBy("g", F.least(F.lit(99), F.floor(F.col("v") * 100)).alias("b")).agg(F.sum("same").alias("h"))
    h = 100.0 * F.col("h") / F.col("n")
    entropy = bins.join(bins.groupBy("g").agg(F.sum("h").alias("n")), "g").groupBy("g").agg((-F.sum(h * F.log(h))).alias("score")).withColumn("metric", F.lit("entropy"))

    def moments(name: str, where) -> list:
        w = F.when(where, F.col("same"))
        return [F.sum(w).alias(f"n{name}"), (F.sum(w * F.col("v")) / F.sum(w)).alias(f"m{name}"), (F.sum(w * F.col("v") * F.col("v")) / F.sum(w)).alias(f"q{name}")]

    m = powers.groupBy("g").agg(*moments("a", F.lit(True)), *moments("t", F.col("top")), *moments("r", ~F.col("top")))
    var = lambda x: F.greatest(F.lit(0.0), F.col(f"q{x}") - F.col(f"m{x}") * F.col(f"m{x}"))
    pooled = F.sqrt(((F.col("nt") - 1) * var("t") + (F.col("nr") - 1) * var("r")) / (F.col("nt") + F.col("nr") - 2) + 1e-12)
    scores = entropy.select("metric", "g", "score")
    for name, value in (("variance", var("a")), ("effect", (F.col("mt") - F.col("mr")) / (pooled + 1e-12))):
        scores = scores.unionByName(m.select(F.lit(name).alias("metric"), "g", value.alias("score")))
    return scores.groupBy("metric").agg(r6(F.max_by("g", "score"), "gamma"), r6(F.max("score"), "score"))


def greedy_sql(order: str, near: str, most: bool = False) -> dict[str, str]:
    """Views that walk through each object's points in order and keep those that none kept before is near; with `most`, till
    as many are kept as the view targets has for the object (300 where it has none)."""
    full = "len(w.kept) >= o.most or " if most else ""
    point = "{'pid': o.pid, 'x': o.x, 'y': o.y, 'z': o.z, 'val': o.val}"
    walk = f"select object, place, [{point}] as kept from ordered o where place = 1 union all select w.object, o.place, case when {full}len(list_filter(w.kept, lambda k: {near})) > 0 then w.kept else list_append(w.kept, {point}) end from walk w join ordered o on o.object = w.object and o.place = w.place + 1"
    ordered = f"select *, row_number() over (partition by object order by {order}) as place from objects"
    if most:
        ordered = f"select o.*, coalesce(n, 300) as most, row_number() over (partition by object order by {order}) as place from objects o left join targets using (object)"
    return {"ordered": ordered, "walk": walk, "ends": "select object, arg_max(kept, place) as kept from walk group by 1", "chosen": "select object, unnest(kept) as k, unnest(range(1, len(kept) + 1)) as seq from ends"}


OBJECTS = {"objects": POINTS.replace("select event_id as pid", "select user_id as object, event_id as pid")}
TARGETS = "select object, cast(floor(quantile_cont(n, 0.5)) as bigint) as n from (select object, grp, count(*) as n from objects where grp <> 'error' group by 1, 2) group by 1"
WITHIN = "(k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) + (k.z - o.z) * (k.z - o.z) <= {}"


@query("select object, k.pid as pid, k.x as x, k.y as y, k.z as z, seq from chosen", True, **OBJECTS, **greedy_sql("pid", WITHIN.format(25)))
def density_thinning(spark, d):
    """Each object's points in input order, without those near one that is kept."""
    return K.spread(points(spark, d).select("object", "pid", "x", "y", "z"), ["object"], [F.col("pid")], 5.0)


@query("select object, k.pid as pid, k.x as x, k.y as y, k.z as z, k.val as val, seq from chosen", True, **OBJECTS, targets=TARGETS, **greedy_sql("val desc, pid", WITHIN.format(64), True))
def spread_selection(spark, d):
    """The hottest points of each object at a distance from each other, as many as the median number of anchors that the
    object's kinds of anchors have; 300 where it has none."""
    p = points(spark, d).select("object", "grp", "pid", "x", "y", "z", "val")
    counts = anchors(p).groupBy("object", "grp").agg(F.count(F.lit(1)).alias("c"))
    n = R.quantiles(counts, ["object"], "c", {"m": 0.5}).select("object", F.floor("m").cast("long").alias("n"))
    n = p.select("object").distinct().join(n, "object", "left").select("object", F.coalesce("n", F.lit(300)).alias("n"))
    return K.spread(p.drop("grp"), ["object"], [-F.col("val"), F.col("pid")], 8.0, n)


FAR = "(p[{0}].x - {1}.x) * (p[{0}].x - {1}.x) + (p[{0}].y - {1}.y) * (p[{0}].y - {1}.y) + (p[{0}].z - {1}.z) * (p[{0}].z - {1}.z)"
FARTHEST = {
    "sets": "select object, list({'pid': pid, 'x': x, 'y': y, 'z': z} order by pid) as p from objects where val > 50 group by 1",
    "walk": f"select object, p, [1] as chosen, list_transform(p, lambda q: {FAR.format(1, 'q')}) as best from sets union all select object, p, list_append(chosen, nxt), list_transform(best, lambda b, i: least(b, {FAR.format('i', 'p[nxt]')})) from (select *, list_position(best, list_max(best)) as nxt from walk) where len(chosen) < least(20, len(p))",
    "ends": "select object, any_value(p) as p, arg_max(chosen, len(chosen)) as chosen from walk group by 1",
}


@query("select object, p[c].pid as pid, p[c].x as x, p[c].y as y, p[c].z as z, seq from (select object, p, unnest(chosen) as c, unnest(range(1, len(chosen) + 1)) as seq from ends)", True, **OBJECTS, **FARTHEST)
def farthest_points(spark, d):
    hot = points(spark, d).where("val > 50").select("object", "pid", "x", "y", "z")
    return K.farthest(hot, ["object"], "pid", 20)


VOXELS = {
    "cells": "select unit, floor(x / 12.5) as i, floor(y / 12.5) as j, floor(z / 12.5) as k, count(*) as n, sum(x) as sx, sum(y) as sy, sum(z) as sz from points where val > 100 group by 1, 2, 3, 4",
    "numbered": "select *, row_number() over (partition by unit order by i, j, k) as id from cells",
    "reach": "select unit, id as root, id from numbered union select r.unit, r.root, b.id from reach r join numbered a on a.unit = r.unit and a.id = r.id join numbered b on b.unit = a.unit and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and abs(a.k - b.k) <= 1",
    "parts": "select unit, id, min(root) as root from reach group by 1, 2",
    "clusters": "select unit, root, cast(sum(n) as bigint) as points, count(*) as voxels, round(sum(sx) / sum(n), 6) as cx, round(sum(sy) / sum(n), 6) as cy, round(sum(sz) / sum(n), 6) as cz from parts join numbered using (unit, id) group by 1, 2",
}


@query("select unit, place, points, voxels, cx, cy, cz from (select *, row_number() over (partition by unit order by points desc, root) as place from clusters) where place <= 3", True, **P, **VOXELS)
def voxel_clusters(spark, d):
    """The three clusters of touching hot voxels with the most points in each unit, and the centroids of their points."""
    hot = points(spark, d).where("val > 100").select("unit", *[F.floor(F.col(k) / 12.5).cast("long").alias(v) for k, v in zip("xyz", "ijk", strict=True)], "x", "y", "z")
    cells = hot.groupBy("unit", "i", "j", "k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"])

    cells = cut(cells)
    parts = K.touching_cells(cells, "unit", ["i", "j", "k"])
    clusters = cells.join(parts, ["unit", "i", "j", "k"]).groupBy("unit", "root").agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("voxels"), *[r6(F.sum(f"s{a}") / F.sum("n"), f"c{a}") for a in "xyz"])
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("points"), "root")).cast("long")
    return clusters.withColumn("place", place).where("place <= 3").drop("root")


PIXELS = {
    "pixels": "select unit, px, py, row_number() over (partition by unit order by px, py) as id from (select distinct unit, floor(x) as px, floor(y) as py from points where val > 120)",
    "near": "select a.unit, a.id as a, b.id as b from pixels a join pixels b on a.unit = b.unit and (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 36",
    "cores": "select unit, a as id from near group by 1, 2 having count(*) >= 3",
    "reach": "select unit, id as root, id from cores union select r.unit, r.root, n.b from reach r join near n on n.unit = r.unit and n.a = r.id join cores c on c.unit = n.unit and c.id = n.b",
    "parts": "select unit, id, min(root) as root from reach group by 1, 2",
    "members": "select * from parts union all select n.unit, n.a, min(p.root) from near n join parts p on p.unit = n.unit and p.id = n.b left join cores c on c.unit = n.unit and c.id = n.a where c.id is null group by 1, 2",
}


@query("select m.unit, dense_rank() over (partition by m.unit order by m.root) - 1 as cluster, count(*) as n, round(avg(px), 6) as cx, round(avg(py), 6) as cy from members m join pixels p on p.unit = m.unit and p.id = m.id group by m.unit, m.root", True, **P, **PIXELS)
def pixel_clusters(spark, d):
    """Dense groups of an image's hot pixels, numbered by their first cores."""
    pixels = points(spark, d).where("val > 120").select("unit", F.floor("x").cast("long").alias("px"), F.floor("y").cast("long").alias("py"))
    found = K.density_clusters(pixels, "unit", 6.0, 3).groupBy("unit", "cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("px"), "cx"), r6(F.avg("py"), "cy"))
    return R.range_ranks(found, ["unit"], "cluster", "place").select("unit", F.col("place").cast("long").alias("cluster"), "n", "cx", "cy")


MATCHES = {
    "two": "select * from objects where grp in ('error', 'click') and val > 40",
    "met": "select a.object, a.pid as i, b.pid as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as dist from two a join two b on a.object = b.object and a.grp = 'click' and b.grp = 'error'",
    "ordered": "select *, row_number() over (partition by object order by dist, i, j) as place from met where dist <= 10",
    "walk": "select object, place, [i] as a, [j] as b, [dist] as dists from ordered where place = 1 union all select w.object, o.place, case when free then list_append(w.a, o.i) else w.a end, case when free then list_append(w.b, o.j) else w.b end, case when free then list_append(w.dists, o.dist) else w.dists end from (select w.*, o.place as next, not list_contains(w.a, o.i) and not list_contains(w.b, o.j) as free from walk w join ordered o on o.object = w.object and o.place = w.place + 1) w join ordered o on o.object = w.object and o.place = w.next",
    "ends": "select object, arg_max(dists, place) as dists from walk group by 1",
}


@query("select object, tp, n_a - tp as fp, n_b - tp as fn, round(tp / nullif(n_a, 0), 6) as precision, round(tp / nullif(n_b, 0), 6) as recall, round(2 * tp / (n_a + n_b), 6) as f1, mean, median, rmse from (select object, coalesce(len(dists), 0) as tp, n_a, n_b, round(list_avg(dists), 6) as mean, round(list_median(dists), 6) as median, round(sqrt(list_avg(list_transform(dists, lambda x: x * x))), 6) as rmse from (select object, count(*) filter (where grp = 'click') as n_a, count(*) filter (where grp = 'error') as n_b from two group by 1) left join ends using (object))", True, **OBJECTS, **MATCHES)
def assignment_match(spark, d):
    """One-to-one pairs of an object's two kinds of points within a radius, the closest first, and how well they fit."""
    both = points(spark, d).where("grp in ('error', 'click') and val > 40").select("object", "grp", "pid", "x", "y", "z")
    a, b = both.where("grp = 'click'").drop("grp"), both.where("grp = 'error'").drop("grp")
    pairs = S.pairs_within(a, b, ["object"], 10.0)
    m = cut(K.closest_first(pairs, "object"))
    fit = R.summary(m, ["object"], {"tp": F.count(F.lit(1)), "mean": F.avg("dist"), "rmse": F.sqrt(F.avg(F.col("dist") * F.col("dist")))}, {"median": ("dist", 0.5)})
    n = both.groupBy("object").agg(F.count_if(F.col("grp") == "click").alias("n_a"), F.count_if(F.col("grp") == "error").alias("n_b"))
    out = n.join(fit, "object", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    tp, n_a, n_b = (F.col(c) for c in ("tp", "n_a", "n_b"))
    share = lambda x, y, name: r6(F.when(y > 0, x / y), name)
    return out.select("object", "tp", (n_a - tp).alias("fp"), (n_b - tp).alias("fn"), share(tp, n_a, "precision"), share(tp, n_b, "recall"), share(2 * tp, n_a + n_b, "f1"), *[r6(F.col(c), c) for c in ("mean", "median", "rmse")])


SEEN = "select *, 30 * unit as az, 18 * (unit - 2) as el, (x - 50) / 50 as wx, (y - 50) / 50 as wy, (z - 50) / 50 as wz from points"
PIXEL = "select *, 500 + 500 * (-sin(radians(az)) * wx + cos(radians(az)) * wy) as u, 500 - 500 * (-sin(radians(el)) * cos(radians(az)) * wx - sin(radians(el)) * sin(radians(az)) * wy + cos(radians(el)) * wz) as v from seen"
REMOVED = "select * from pixel where pid % 2 = 0 and u >= 0 and u < 1000 and v >= 0 and v < 1000 and (cast(floor(u * 11 / 1000) as bigint) * 3 + cast(floor(v * 11 / 1000) as bigint)) % 17 = 0"


@query("select unit, count(*) as kept from points a where not exists (select 1 from removed g where g.unit = a.unit and (a.x - g.x) * (a.x - g.x) + (a.y - g.y) * (a.y - g.y) + (a.z - g.z) * (a.z - g.z) <= 4) group by 1", **P, seen=SEEN, pixel=PIXEL, removed=REMOVED)
def rejected_views(spark, d):
    """Points of a unit that lie away from all that its view shows in rejected cells: visible points are projected to
    pixels, those in rejected cells of the image are taken out, and all points near one of them with them."""
    p = points(spark, d).select("unit", "pid", "x", "y", "z")
    az, el = F.radians(30 * F.col("unit")), F.radians(18 * (F.col("unit") - 2))
    x, y, z = ((F.col(k) - 50) / 50 for k in "xyz")
    u = 500 + 500 * (-F.sin(az) * x + F.cos(az) * y)
    v = 500 - 500 * (-F.sin(el) * F.cos(az) * x - F.sin(el) * F.sin(az) * y + F.cos(el) * z)
    cell = (F.floor(F.col("u") * 11 / 1000) * 3 + F.floor(F.col("v") * 11 / 1000)) % 17
    inside = "u >= 0 and u < 1000 and v >= 0 and v < 1000"
    out = p.where("pid % 2 = 0").withColumns({"u": u, "v": v}).where(inside).where(cell == 0).select("unit", "x", "y", "z")
    return S.within_radius(p, out, ["unit"], 2.0, anti=True).groupBy("unit").agg(F.count(F.lit(1)).alias("kept"))
