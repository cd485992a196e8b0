"""Queries that compare units, levels and tiers: ratios, gains, coverage, attrition, samples, tests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import robust as R
from ..operators import select as K
from ..operators import spatial as S
from ..sources.tables import cut
from .meshes import T1, geometry, tets
from .points import D2, G, P, anchors, points, r6
from .registry import query
from .trials import COMPLETE, F1, PAIRS, S1, UNIT, V, firsts, ok, pairs, rounded, swept, trials
from .viewsets import R as GRIDS
from .viewsets import grid


@query("select object, load_case from firsts where method in ('coarse', 'zz_oracle', 'mech_sub') group by 1, 2 having count(distinct method) = 2", **F1)
def two_method_units(spark, d):
    """Units that have exactly two of three methods."""
    return C.units_with_exactly(firsts(spark, d).where(F.col("method").isin("coarse", "zz_oracle", "mech_sub")), 2)


@query("select object, size from (select distinct object from trials) join (select object, max(n_cells) as size from ok where method = 'coarse' and source_rank = 0 group by 1) using (object) where size > 0 and size <= 1950", **V)
def size_cap(spark, d):
    """Objects of at most some size; those of unknown size are left out."""
    size = ok(spark, d).where("method = 'coarse' and source_rank = 0").groupBy("object").agg(F.max("n_cells").alias("size"))
    return C.capped(trials(spark, d).select("object").distinct(), size, ["object"], "size", 1950.0)


@query("select h_scale, count(*) as n, round(avg(a - b), 6) as mean_d, round(quantile_cont(a - b, 0.5), 6) as median_d from (select object, load_case, h_scale, avg(case when method = 'proposed_max' then vm end) as a, avg(case when method = 'zz_oracle' then vm end) as b from swept group by 1, 2, 3) where a is not null and b is not null group by 1", **S1)
def paired_by_level(spark, d):
    """Differences of two methods by unit and level, in one pass."""
    p = R.paired(swept(spark, d), [*UNIT, "h_scale"], "method", "proposed_max", "zz_oracle", "vm")
    return rounded(R.summary(p, ["h_scale"], {"n": F.count(F.lit(1)), "mean_d": F.avg("d")}, {"median_d": ("d", 0.5)}), "mean_d", "median_d")


@query("select object, round(sum(loc) / greatest(sum(fine), 1), 6) as prec, count(*) as n, round(avg(fine), 6) as mean_fine, round(quantile_cont(fine, 0.5), 6) as median_fine from (select object, vec_id, count(*) filter (where cbrt(volume) <= 0.1) as fine, count(*) filter (where cbrt(volume) <= 0.1 and cx > 0.0) as loc from geo group by 1, 2) group by 1", **T1)
def fine_precision(spark, d):
    """Share of fine elements that lie where they should, over all cases of an object; 0 where there are none."""
    fine, here = F.cbrt("volume") <= 0.1, F.col("cx") > 0.0
    case = geometry(tets(spark, d)).groupBy("object", "vec_id").agg(F.count_if(fine).alias("fine"), F.count_if(fine & here).alias("loc"))
    plain = {"prec": F.sum("loc") / F.greatest(F.sum("fine"), F.lit(1)), "n": F.count(F.lit(1)), "mean_fine": F.avg("fine")}
    return rounded(R.summary(case, ["object"], plain, {"median_fine": ("fine", 0.5)}), "prec", "mean_fine", "median_fine")


@query("select load_case, count(*) as n, round(avg(case when a < b then 1.0 else 0.0 end), 6) as win, round(quantile_cont(a / nullif(b, 0), 0.5), 6) as median_ratio from (select object, load_case, avg(case when method = 'proposed_max' then en end) as a, avg(case when method = 'heuristic_sub' then en end) as b from ok group by 1, 2) where a is not null and b is not null group by 1", **V)
def pair_ratio(spark, d):
    """How often one method is below the other, and the median of their ratios; a ratio to 0 is none."""
    p = R.paired(ok(spark, d), UNIT, "method", "proposed_max", "heuristic_sub", "en").withColumn("ratio", F.when(F.col("b") != 0, F.col("a") / F.col("b")))
    plain = {"n": F.count(F.lit(1)), "win": F.avg(F.when(F.col("a") < F.col("b"), 1.0).otherwise(0.0))}
    return rounded(R.summary(p, ["load_case"], plain, {"median_ratio": ("ratio", 0.5)}), "win", "median_ratio")


def crossed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Anchors that a method placed for load case `of` of an object, and the hot points of each load case of the objects."""
    return placed_anchors(spark, d), cut(hot_points(spark, d))


def anchor_hits(a: DataFrame, gt: DataFrame) -> DataFrame:
    """(object, load_case, of, method, n_a, m_a): anchors, and those near a hot point of the load case, of the same object."""
    return S.cross_hits(a, gt, ["object"], ["of", "method"], ["load_case"], CROSS_RADIUS).withColumnsRenamed({"n": "n_a", "hits": "m_a"})


CROSS_RADIUS = 25.0
HOT = "select object, load_case, x, y, z from (select *, quantile_cont(val, 0.9) over (partition by object, load_case) as c from (select *, pid % 50 as object, grp as load_case from points) where pid % 3 = 0) where val >= c"
PLACED = "select pid % 50 as object, grp as of, pid % 3 as method, x, y, z from points where pid % 3 > 0"
CROSS = f"""select a.object, g.load_case, a.of, a.method, count(distinct a.i) as n_a, count(distinct case when {D2} <= {CROSS_RADIUS * CROSS_RADIUS} then a.i end) as m_a, count(distinct g.j) as n_g,
  count(distinct case when {D2} <= {CROSS_RADIUS * CROSS_RADIUS} then g.j end) as m_g from (select *, row_number() over () as i from placed) a join (select *, row_number() over () as j from hot) g on a.object = g.object group by 1, 2, 3, 4"""
X1 = P | {"hot": HOT, "placed": PLACED, "crossed": CROSS}


def hot_points(spark, d) -> DataFrame:
    p = points(spark, d).where("pid % 3 = 0").select((F.col("pid") % 50).alias("object"), F.col("grp").alias("load_case"), "x", "y", "z", "val")
    return S.percentile_cut(p, ["object", "load_case"], "val", 0.9).drop("val")


def placed_anchors(spark, d) -> DataFrame:
    return points(spark, d).where("pid % 3 > 0").select((F.col("pid") % 50).alias("object"), F.col("grp").alias("of"), (F.col("pid") % 3).alias("method"), "x", "y", "z")


@query("select load_case, of, method, cast(sum(n_a) as bigint) as n, cast(sum(m_a) as bigint) as hits from crossed where load_case <> of group by 1, 2, 3", **X1)
def load_discrimination(spark, d):
    """Anchors placed for one load case of an object against the hot points of its other load cases, by method."""
    c = anchor_hits(*crossed(spark, d)).where("load_case <> of")
    return c.groupBy("load_case", "of", "method").agg(F.sum("n_a").alias("n"), F.sum("m_a").alias("hits"))


@query("select object, load_case, method, n_mismatch, round(p, 6) as precision_matched, round(r, 6) as recall_matched, round(p - px, 6) as gain_precision, round(r - rx, 6) as gain_recall, round(f - fx, 6) as gain_f1 from (select object, load_case, method, count(*) filter (where of <> load_case) as n_mismatch, max(case when of = load_case then p end) as p, max(case when of = load_case then r end) as r, max(case when of = load_case then f end) as f, avg(case when of <> load_case then p end) as px, avg(case when of <> load_case then r end) as rx, avg(case when of <> load_case then f end) as fx from (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from (select *, m_a / n_a as p, m_g / n_g as r from crossed)) group by 1, 2, 3) where p is not null and n_mismatch > 0", **X1)
def discrimination_gain(spark, d):
    """How much better a method's anchors fit the load case that they were placed for than those for its object's other load cases do."""
    values = dict(zip("prf", S.prf(F.col("m_a"), F.col("n_a"), F.col("m_g"), F.col("n_g")), strict=True))
    own = F.col("of") == F.col("load_case")
    a, gt = crossed(spark, d)
    a = cut(a)
    back = S.cross_hits(gt, a, ["object"], ["load_case"], ["of", "method"], CROSS_RADIUS, few=True).withColumnsRenamed({"n": "n_g", "hits": "m_g"})
    n = anchor_hits(a, gt).join(back, ["object", "load_case", "of", "method"]).select("object", "load_case", "method", "of", *[v.alias(k) for k, v in values.items()])
    g = n.groupBy("object", "load_case", "method").agg(F.count_if(~own).alias("n_mismatch"), *[x for k in "prf" for x in (F.max(F.when(own, F.col(k))).alias(k), F.avg(F.when(~own, F.col(k))).alias(f"{k}x"))])
    gain = {k: r6(F.col(k) - F.col(f"{k}x"), f"gain_{n}") for k, n in zip("prf", ("precision", "recall", "f1"), strict=True)}
    return g.where("p is not null and n_mismatch > 0").select("object", "load_case", "method", "n_mismatch", r6(F.col("p"), "precision_matched"), r6(F.col("r"), "recall_matched"), *gain.values())


TIERS = "select unit, pid, r, x, y, z, unnest(case when place <= 20 and place <= greatest(20, ceil(c / 100.0)) then ['top20', 'share'] when place <= greatest(20, ceil(c / 100.0)) then ['share'] else [] end) as tier from (select *, row_number() over (partition by unit order by val desc, pid) as place, count(*) over (partition by unit) as c from points where grp = 'error')"
TIER_NEAR = f"select g.unit, g.tier, g.pid, (select min(sqrt({D2})) from anchors a where a.unit = g.unit) / g.r as dist from tiers g"


@query("select unit, tier, count(*) as n, round(quantile_cont(dist, 0.5), 6) as median, round(quantile_cont(dist, 0.9), 6) as p90, round(max(dist), 6) as worst, " + ", ".join(f"round(avg(case when dist <= {k} then 1.0 else 0.0 end), 6) as within{k}" for k in (1, 2, 4)) + " from near group by 1, 2", **G, tiers=TIERS, near=TIER_NEAR)
def coverage_tiers(spark, d):
    """Distances in sizes from the hottest points to the nearest anchor, for two tiers: the first 20, and one in 100 (20 at least)."""
    p = points(spark, d)
    hot = p.where("grp = 'error'")
    n = hot.groupBy("unit").agg(F.greatest(F.lit(20), F.ceil(F.count(F.lit(1)) / 100.0)).alias("n"))
    share = R.top_n(hot, ["unit"], "val", "pid", n)
    first = R.top_n(hot, ["unit"], "val", "pid", n.withColumn("n", F.lit(20))).select("unit", "pid", F.lit("top20").alias("first"))
    dist = S.nearest(share, anchors(p), "unit").select("unit", "pid", "dist")
    tier = F.array_compact(F.array("first", F.lit("share")))
    t = share.join(dist, ["unit", "pid"]).join(first, ["unit", "pid"], "left").select("unit", F.explode(tier).alias("tier"), (F.col("dist") / F.col("r")).alias("dist"))
    within = {f"within{k}": F.avg(F.when(F.col("dist") <= k, 1.0).otherwise(0.0)) for k in (1, 2, 4)}
    out = R.summary(cut(t), ["unit", "tier"], {"n": F.count(F.lit(1)), "worst": F.max("dist"), **within}, {"median": ("dist", 0.5), "p90": ("dist", 0.9)})
    return rounded(out, "worst", *within, "median", "p90")


@query("select 'rows' as stage, count(*) as n, count(distinct object) as objects from trials union all select 'ok', count(*), count(distinct object) from ok union all select 'first', count(*), count(distinct object) from firsts union all select 'complete', count(*), count(distinct object) from complete union all select 'strict', count(*), count(*) from (select object from complete group by 1 having count(distinct load_case) = 5)", **F1, complete=COMPLETE)
def attrition(spark, d):
    """How many rows or units and objects each rule of a cohort leaves."""
    f = firsts(spark, d)
    complete = C.complete_units(f, 6)
    count = lambda df, stage: df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object").alias("objects")).select(F.lit(stage).alias("stage"), "n", "objects")
    out = count(trials(spark, d), "rows")
    for df, stage in ((ok(spark, d), "ok"), (f, "first"), (complete, "complete"), (C.strict_objects(complete, 5), "strict")):
        out = out.unionByName(count(df, stage))
    return out


@query("select pid, unit from (select *, row_number() over (partition by unit, load order by val desc, pid) as place, sum(case when val >= c then 1 else 0 end) over (partition by unit, load) as over from (select *, quantile_cont(val, 0.7) over (partition by unit, load) as c from (select *, case when pid % 50 = 0 then 'rare' else grp end as load from points))) where case when over >= 15 then val >= c else place <= 15 end", **P)
def top_share_or_least(spark, d):
    """The top 30 % of each group, or its 15 hottest points where these are more."""
    load = F.when(F.col("pid") % 50 == 0, "rare").otherwise(F.col("grp"))
    return S.top_share(points(spark, d).withColumn("load", load), ["unit", "load"], "val", 0.3, 15, "pid").select("pid", "unit")


RAYS = "select user_id as view, event_type as ray, min(value) as hit, user_id % 20 + 0.5 as target from events group by 1, 2, 4"


@query("select view, count(*) as rays, count(*) filter (where abs(hit - target) <= 5) as seen, round(avg(hit), 6) as mean_hit from rays group by 1 having count(*) filter (where abs(hit - target) <= 5) > 0.1 * count(*)", rays=RAYS)
def visible_views(spark, d):
    """Views from which over a tenth of the rays first meet something where their target lies."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rays = e.groupBy(F.col("user_id").alias("view"), F.col("event_type").alias("ray")).agg(F.min("value").alias("hit"))
    seen = F.abs(F.col("hit") - (F.col("view") % 20 + 0.5)) <= 5
    v = rays.groupBy("view").agg(F.count(F.lit(1)).alias("rays"), F.count_if(seen).alias("seen"), r6(F.avg("hit"), "mean_hit"))
    return v.where(F.col("seen") > 0.1 * F.col("rays"))


@query("select object, load_case, method, seq from ok order by md5('11|' || cast(seq as varchar)), seq limit (select count(*) // 3 from ok)", **V)
def subsample_total(spark, d):
    """A third of all rows of all groups together, in random order that doesn't change."""
    rows = ok(spark, d).select(*UNIT, "method", "seq")
    return K.sample_rows(rows, ["seq"], rows.agg(F.floor(F.count(F.lit(1)) / 3).alias("n")), seed=11)


@query("select model, prompt, view_type, k, round(avg(precision), 6) as mean, round(stddev_samp(precision), 6) as sd, count(precision) as n from grid group by 1, 2, 3, 4", **GRIDS)
def full_std(spark, d):
    return grid(spark, d).groupBy("model", "prompt", "view_type", "k").agg(r6(F.avg("precision"), "mean"), r6(F.stddev_samp("precision"), "sd"), F.count("precision").alias("n"))


@query("select count(*) filter (where a and b) as both_have, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b, count(*) as any_has from (select object, load_case, bool_or(source_rank = 0) as a, bool_or(source_rank = 1) as b from ok where source_rank < 2 group by 1, 2)", **V)
def cohort_overlap(spark, d):
    """Units of two tagged sources: shared, in one only, in any; one aggregate in place of three set operations."""
    tagged = [ok(spark, d).where(F.col("source_rank") == i).select(*UNIT, F.lit(t).alias("tag")) for i, t in enumerate("ab")]
    has = lambda t: F.bool_or(F.col("tag") == t)
    u = tagged[0].unionByName(tagged[1]).groupBy(*UNIT).agg(has("a").alias("a"), has("b").alias("b"))
    return u.agg(F.count_if(F.col("a") & F.col("b")).alias("both_have"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count(F.lit(1)).alias("any_has"))


def with_p(df: DataFrame) -> DataFrame:
    """Signed-rank results with p for both sides and each one; a row per comparison."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{"p_" + s.removesuffix("-sided"): [R.signed_rank_p(int(n), float(w), float(t), s) for n, w, t in zip(f["n"], f["w_plus"], f["tie_term"], strict=True)] for s in ("two-sided", "less", "greater")})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(add, f"{schema}, p_two double, p_less double, p_greater double")


# the error function's power series, good to six digits up to 4; beyond that the rest is below what is kept
ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: (1 - 2 * (n % 2)) * exp((2 * n + 1) * ln(greatest(x, 1e-12)) - lgamma(n + 1)) / (2 * n + 1)))"
SIGNED = """select method, load_case, count(*) as n, sum(case when d > 0 then r else 0 end) as w_plus, any_value(tt) as tt from (select *, rank() over (partition by method, load_case order by abs(d)) + (count(*) over (partition by method, load_case, abs(d)) - 1) / 2.0 as r from pairs where d <> 0)
    join (select method, load_case, sum(c * c * c - c) as tt from (select method, load_case, abs(d), count(*) as c from pairs where d <> 0 group by 1, 2, 3) group by 1, 2) using (method, load_case) group by 1, 2"""
SCORES = f"select *, case when x > 4 then 1 else {ERF} end as e from (select *, abs(z) / sqrt(2) as x from (select *, (w_plus - n * (n + 1) / 4.0) / sqrt(nullif(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0, 0)) as z from signed))"
# in how many of the 2 ** n ways of signs the ranks with a plus add up to each sum
WAYS = "select 0 as n, [1::bigint] as w union all select n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda s: coalesce(w[s + 1], 0) + case when s > n then coalesce(w[s - n], 0) else 0 end) from ways where n < 50"
EXACT = "select s.*, list_sum(w[1:cast(w_plus as bigint) + 1]) / pow(2, s.n) as low, list_sum(w[cast(w_plus as bigint) + 1:]) / pow(2, s.n) as high from scores s left join ways on ways.n = s.n and s.tt = 0"


@query(
    "select method, load_case, n, round(z, 6) as z, round(case when low is not null then least(1, 2 * least(low, high)) else 1 - e end, 6) as p_two, round(case when low is not null then low when z < 0 then (1 - e) / 2 else (1 + e) / 2 end, 6) as p_less, "
    "round(case when low is not null then high when z > 0 then (1 - e) / 2 else (1 + e) / 2 end, 6) as p_greater from exact",
    True, **F1, pairs=PAIRS, signed=SIGNED, scores=SCORES, ways=WAYS, exact=EXACT,
)
def signed_rank_p(spark, d):
    """p of the paired tests of each load case: exact for 50 units or fewer without ties, else by the normal distribution."""
    r = with_p(R.signed_rank(cut(pairs(spark, d).select("method", "load_case", "d")), ["method", "load_case"]))
    return r.select("method", "load_case", "n", *[r6(F.col(c), c) for c in ("z", "p_two", "p_less", "p_greater")])
