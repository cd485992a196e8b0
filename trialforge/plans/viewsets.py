"""Queries over views of objects and over the grid of view counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import select as K
from ..sources.tables import cut, new_folder
from .registry import query
from .trials import TRIALS, trials

ELEVATIONS = [-90, -72, -54, -36, -18, 0, 18, 36, 54, 72, 90]
VIEWS = "select vec_id as view, label as object, cast(embedding[1] as double) as score, 30 * (vec_id % 12) as az, ([" + ", ".join(map(str, ELEVATIONS)) + "])[cast(floor(vec_id / 12.0) as bigint) % 11 + 1] as el from embeddings"
W = {"views": VIEWS}
GRID = """select user_id % 40 as mesh, event_type as load, event_id % 4 as model, cast(floor(event_id / 4.0) as bigint) % 3 as prompt, event_id % 2 as view_type,
  1 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 10 as k, case when event_id % 23 = 0 then null else value / 500 end as precision,
  cast(regexp_extract(props, '([0-9]+)', 1) as double) / 100 as recall, cast(floor(value) as bigint) as n_points, cast(floor(value / 3) as bigint) as n_matched from events"""
R = {"grid": GRID}


def views(spark, d) -> DataFrame:
    e, v = spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id")
    return e.select(v.alias("view"), F.col("label").alias("object"), F.get("embedding", F.lit(0)).cast("double").alias("score"), (30 * (v % 12)).alias("az"), F.get(F.array(*[F.lit(x) for x in ELEVATIONS]), (F.floor(v / 12.0) % 11).cast("int")).alias("el"), "embedding")


def grid(spark, d) -> DataFrame:
    c, e = F.col, spark.read.parquet(f"{d}/events.parquet")
    z = F.regexp_extract("props", "([0-9]+)", 1)
    return e.select(
        (c("user_id") % 40).alias("mesh"), c("event_type").alias("load"), (c("event_id") % 4).alias("model"), (F.floor(c("event_id") / 4.0) % 3).alias("prompt"), (c("event_id") % 2).alias("view_type"), (1 + z.cast("long") % 10).alias("k"),
        F.when(c("event_id") % 23 != 0, c("value") / 500).alias("precision"), (z.cast("double") / 100).alias("recall"), F.floor("value").cast("long").alias("n_points"), F.floor(c("value") / 3).cast("long").alias("n_matched"),
    )


def direction(az: Column, el: Column) -> list[Column]:
    """The unit vector towards a view."""
    a, e = F.radians(az), F.radians(el)
    return [F.cos(e) * F.cos(a), F.cos(e) * F.sin(a), F.sin(e)]


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def unit_vectors(g) -> np.ndarray:
    a, e = np.radians(g["az"].to_numpy(float)), np.radians(g["el"].to_numpy(float))
    return np.stack([np.cos(e) * np.cos(a), np.cos(e) * np.sin(a), np.sin(e)], axis=1)


def ranked() -> Column:
    """Views are ranked by score, those without one last, then by number."""
    return F.when(~F.isnan("score"), F.col("score"))


def best_at_places(spark, d) -> DataFrame:
    """The first view of each object at each place of the grid of views. What is similar to one view is similar to all at
    its place, so those after it are suppressed with it or by it."""
    v = views(spark, d).drop("embedding")
    best = v.groupBy("object", "el", "az").agg(F.min_by(F.struct("view", "score"), F.struct(ranked().isNull(), -ranked(), "view")).alias("b"))
    return best.select("b.view", "object", "b.score", "az", "el")


def suppress(df: DataFrame, vectors, similar, last_only: bool = False) -> DataFrame:
    return K.suppressed(df, "object", [ranked().isNull(), -ranked(), F.col("view")], vectors, similar, last_only)


def nms_sql(similar: str, columns: str, last_only: bool = False) -> dict[str, str]:
    """Views that walk through each object's views by score and keep those that aren't similar to any (the last) kept."""
    kept = "w.kept[len(w.kept):]" if last_only else "w.kept"
    row = f"{{'view': o.view, 'score': o.score, 'az': o.az, 'el': o.el, {columns}}}"
    walk = f"select object, place, [{row}] as kept from ordered o where place = 1 union all select w.object, o.place, case when len(list_filter({kept}, lambda k: {similar})) > 0 then w.kept else list_append(w.kept, {row}) end from walk w join ordered o on o.object = w.object and o.place = w.place + 1"
    vectors = "select v.*, radians(az) as a, radians(el) as e, cast(m.embedding as double[]) as m from views v join embeddings m on m.vec_id = v.view"
    return {"vectors": vectors, "ordered": "select *, row_number() over (partition by object order by isnan(score), score desc, view) as place from vectors", "walk": walk, "ends": "select object, arg_max(kept, place) as kept from walk group by 1", "chosen": "select object, unnest(kept) as k, unnest(range(1, len(kept) + 1)) as seq from ends"}


CHOSEN = "select object, k.view as view, k.score as score, k.az as az, k.el as el, seq from chosen"
UNIT_DOT = "k.x * cos(o.e) * cos(o.a) + k.y * cos(o.e) * sin(o.a) + k.z * sin(o.e)"
UNIT_COLUMNS = "'x': cos(o.e) * cos(o.a), 'y': cos(o.e) * sin(o.a), 'z': sin(o.e)"
QUATERNION = ["cos({0}.a / 2) * cos({0}.e / 2)", "-sin({0}.a / 2) * sin({0}.e / 2)", "cos({0}.a / 2) * sin({0}.e / 2)", "sin({0}.a / 2) * cos({0}.e / 2)"]
Q_DOT = " + ".join(f"k.q{i} * ({q.format('o')})" for i, q in enumerate(QUATERNION))
Q_COLUMNS = ", ".join(f"'q{i}': {q.format('o')}" for i, q in enumerate(QUATERNION))


@query(CHOSEN, True, **W, **nms_sql(f"{UNIT_DOT} > cos(radians(30)) + 1e-9", UNIT_COLUMNS))
def angle_nms(spark, d):
    """Views at just 30 degrees, which the grid of views has, aren't similar."""
    least = np.cos(np.radians(30.0)) + 1e-9
    return suppress(best_at_places(spark, d), unit_vectors, lambda a, x: a @ x > least)


@query(CHOSEN, True, **W, **nms_sql(f"{UNIT_DOT} > 1e-9", UNIT_COLUMNS, True))
def last_kept_nms(spark, d):
    """A place may be kept again once another one was kept, so all views are met."""
    return suppress(views(spark, d).drop("embedding"), unit_vectors, lambda a, x: a @ x > 1e-9, last_only=True)


@query(CHOSEN, True, **W, **nms_sql("list_dot_product(k.m, o.m) >= 0.3 * sqrt(list_dot_product(k.m, k.m)) * sqrt(list_dot_product(o.m, o.m))", "'m': o.m"))
def cosine_nms(spark, d):
    def vectors(g):
        m = np.stack(g["embedding"].to_list()).astype(float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    return suppress(views(spark, d), vectors, lambda a, x: a @ x >= 0.3).drop("embedding")


@query(CHOSEN, True, **W, **nms_sql(f"2 * acos(least(1, abs({Q_DOT}))) < 1.5", Q_COLUMNS))
def diverse_views(spark, d):
    """Views whose rotation lies at least 1.5 radians from those of all views kept before, by quaternions."""

    def quaternions(g):
        a, e = np.radians(g["az"].to_numpy(float)) / 2, np.radians(g["el"].to_numpy(float)) / 2
        return np.stack([np.cos(a) * np.cos(e), -np.sin(a) * np.sin(e), np.cos(a) * np.sin(e), np.sin(a) * np.cos(e)], axis=1)

    return suppress(best_at_places(spark, d), quaternions, lambda a, x: 2 * np.arccos(np.clip(np.abs(a @ x), 0, 1)) < 1.5)


@query("select object, view, row_number() over (partition by object order by score desc, view) as place from views qualify place <= 20", **W)
def rank_views(spark, d):
    w = Window.partitionBy("object").orderBy(F.desc("score"), "view")
    return views(spark, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20").select("object", "view", "place")


@query("select object, el, az, coalesce(s, 0) as score from (select distinct object from views) cross join (select unnest([" + ", ".join(map(str, ELEVATIONS)) + "]) as el) cross join (select 30 * r as az from range(0, 12) t(r)) left join (select object, el, az, round(max(score), 6) as s from views group by 1, 2, 3) using (object, el, az)", **W)
def label_vectors(spark, d):
    """A score for each object and place of the grid of views, 0 where there is no label."""
    v = views(spark, d)
    g = v.select("object").distinct().select("object", F.explode(F.array(*[F.lit(e) for e in ELEVATIONS])).alias("el")).select("object", "el", F.explode(F.sequence(F.lit(0), F.lit(330), F.lit(30))).alias("az"))
    s = v.groupBy("object", "el", "az").agg(r6(F.max("score"), "s"))
    return g.join(s, ["object", "el", "az"], "left").select("object", "el", "az", F.coalesce("s", F.lit(0.0)).alias("score"))


PROJECTED = "select view, -sin(radians(az)) * score + cos(radians(az)) * 0.5 as x, -sin(radians(el)) * cos(radians(az)) * score - sin(radians(el)) * sin(radians(az)) * 0.5 + cos(radians(el)) * 0.25 as y, 3 - (cos(radians(el)) * cos(radians(az)) * score + cos(radians(el)) * sin(radians(az)) * 0.5 + sin(radians(el)) * 0.25) as depth from views"
FOCUS = 500 / np.tan(np.radians(37.5))


@query(f"select view, round(500 + 500 * x, 4) as u, round(500 - 500 * y, 4) as v, round(500 + {FOCUS!r} * x / case when abs(depth) < 1e-6 then 1e-6 else depth end, 4) as pu, round(500 - {FOCUS!r} * y / case when abs(depth) < 1e-6 then 1e-6 else depth end, 4) as pv from projected".replace("np.float64(", "(" ), **W, projected=PROJECTED)
def world_to_pixel(spark, d):
    """Where each view's image of 1000 x 1000 pixels shows the point (score, 0.5, 0.25): orthographic with a half height of
    1, and in perspective from a distance of 3 at 75 degrees."""
    a, e = F.radians("az"), F.radians("el")
    p = [F.col("score"), F.lit(0.5), F.lit(0.25)]
    right, up = [-F.sin(a), F.cos(a), F.lit(0.0)], [-F.sin(e) * F.cos(a), -F.sin(e) * F.sin(a), F.cos(e)]
    dot = lambda q: sum((x * y for x, y in zip(p, q, strict=True)), F.lit(0.0))
    at = views(spark, d).select("view", dot(right).alias("x"), dot(up).alias("y"), (3 - dot(direction(F.col("az"), F.col("el")))).alias("depth"))
    depth = F.when(F.abs("depth") < 1e-6, 1e-6).otherwise(F.col("depth"))
    f = F.lit(float(FOCUS))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return at.select("view", r4(500 + 500 * F.col("x"), "u"), r4(500 - 500 * F.col("y"), "v"), r4(500 + f * F.col("x") / depth, "pu"), r4(500 - f * F.col("y") / depth, "pv"))


UP = "case when abs(sin(radians(el))) > 0.99 then 1 else 0 end"
AROUND = {
    "towards": f"select distinct el, az, cos(radians(el)) * sin(radians(az)) as x, sin(radians(el)) as y, -cos(radians(el)) * cos(radians(az)) as z, {UP} as tip from views",
    # up x v, with up = (0, 1, 0), or (1, 0, 0) for views from above or below
    "first": "select *, case tip when 0 then z else 0 end / l as ux, case tip when 0 then 0 else -z end / l as uy, case tip when 0 then -x else y end / l as uz from (select *, case tip when 0 then sqrt(x * x + z * z) else sqrt(y * y + z * z) end as l from towards)",
    "second": "select *, y * uz - z * uy as wx, z * ux - x * uz as wy, x * uy - y * ux as wz from first",
    "four": "select el, az, k, case k when 0 then ux when 1 then wx when 2 then -ux else -wx end as px, case k when 0 then uy when 1 then wy when 2 then -uy else -wy end as py, case k when 0 then uz when 1 then wz when 2 then -uz else -wz end as pz from second cross join range(0, 4) t(k)",
}


@query("select el, az, k, cast(round(degrees(asin(greatest(-1, least(1, py))))) as bigint) as el2, case when abs(py) > 1 - 1e-9 then 0 else cast(round(degrees(atan2(px, -pz)) + 360) as bigint) % 360 end as az2 from four", **W, **AROUND)
def perpendicular_views(spark, d):
    """The four views at right angles to each view, in whole degrees; the azimuth of one from above or below is 0."""
    v = views(spark, d).select("el", "az").distinct()
    e, a = F.radians("el"), F.radians("az")
    v = v.withColumns({"x": F.cos(e) * F.sin(a), "y": F.sin(e), "z": -F.cos(e) * F.cos(a)})
    x, y, z = (F.col(k) for k in "xyz")
    tip = F.abs(y) > 0.99
    v = v.withColumn("l", F.when(tip, F.sqrt(y * y + z * z)).otherwise(F.sqrt(x * x + z * z)))
    v = v.withColumn("u", F.transform(F.when(tip, F.array(F.lit(0.0), -z, y)).otherwise(F.array(z, F.lit(0.0), -x)), lambda c: c / F.col("l")))
    u = [F.col("u")[i] for i in range(3)]
    v = v.withColumn("w", F.array(y * u[2] - z * u[1], z * u[0] - x * u[2], x * u[1] - y * u[0]))
    turned = lambda c: F.transform(c, lambda q: -q)
    v = v.select("el", "az", F.posexplode(F.array("u", "w", turned("u"), turned("w"))).alias("k", "p"))
    px, py, pz = (F.col("p")[i] for i in range(3))
    el2 = F.round(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), py))))).cast("long")
    az2 = F.when(F.abs(py) > 1 - 1e-9, F.lit(0)).otherwise(F.round(F.degrees(F.atan2(px, -pz)) + 360).cast("long") % 360)
    return v.select("el", "az", "k", el2.alias("el2"), az2.alias("az2"))


@query("select a.object, a.view as a, b.view as b, round(2 * acos(least(1, abs(" + " + ".join(f"({q.format('a')}) * ({q.format('b')})" for q in QUATERNION) + "))), 5) as dist from best a join best b on a.object = b.object and a.view < b.view", **W, best="select object, el, az, arg_min(view, struct_pack(n := isnan(score), s := -score, v := view)) as view, any_value(radians(az)) as a, any_value(radians(el)) as e from views group by 1, 2, 3")
def view_distances(spark, d):
    """Angles between the rotations of an object's views, one for each place of the grid of views (132 at most)."""
    q = lambda a, e: F.array(F.cos(a) * F.cos(e), -F.sin(a) * F.sin(e), F.cos(a) * F.sin(e), F.sin(a) * F.cos(e))
    v = best_at_places(spark, d).select("object", "view", q(F.radians("az") / 2, F.radians("el") / 2).alias("q"))
    both = v.select("object", F.col("view").alias("a"), F.col("q").alias("qa")).join(v.select("object", F.col("view").alias("b"), F.col("q").alias("qb")), "object").where("a < b")
    dot = sum((F.col("qa")[i] * F.col("qb")[i] for i in range(4)), F.lit(0.0))
    return both.select("object", "a", "b", F.round(2 * F.acos(F.least(F.lit(1.0), F.abs(dot))), 5).alias("dist"))


@query("select object, avg(hit) as share from (select object, case when degrees(acos(greatest(-1, least(1, cos(radians(el)) * cos(radians(az)))))) < 90 then 1.0 else 0.0 end as hit from views) group by 1".replace("avg(hit) as share", "round(avg(hit), 6) as share").replace("< 90", "< 89.9"), **W)
def view_angles(spark, d):
    """Share of an object's views that lie within 89.9 degrees of the x axis."""
    x = direction(F.col("az"), F.col("el"))[0]
    near = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))) < 89.9
    return views(spark, d).groupBy("object").agg(r6(F.avg(F.when(near, 1.0).otherwise(0.0)), "share"))


@query("select object, view, row_number() over (partition by object order by n, view) as place from (select object, view, sum(case when h is null then 2 when h < p - 1e-4 then 1 else 0 end) as n from (select object, view, unnest(generate_series(0, 7)) as k, case when unnest(generate_series(0, 7)) % 3 = 0 then null else cast(embedding[unnest(generate_series(0, 7)) + 1] as double) end as h, 0.0 as p from (select vec_id as view, label as object, embedding from embeddings)) group by 1, 2)")
def occlusion_rank(spark, d):
    """Views by how many of their points are hidden (1 each) or missed (2 each), least first."""
    p = views(spark, d).select("object", "view", F.posexplode(F.slice("embedding", 1, 8)).alias("k", "h"))
    hit = F.when(F.col("k") % 3 != 0, F.col("h").cast("double"))
    n = p.groupBy("object", "view").agg(F.sum(F.when(hit.isNull(), 2).when(hit < -1e-4, 1).otherwise(0)).alias("n"))
    return n.select("object", "view", F.row_number().over(Window.partitionBy("object").orderBy("n", "view")).cast("long").alias("place"))


DIMS = ["model", "prompt", "view_type"]


@query(" union all ".join(f"select '{c}' as dim, {c} as level, round(avg(precision), 6) as mean, round(stddev_samp(precision), 6) as sd, count(precision) as n from grid group by {c}" for c in DIMS), **R)
def marginal_std(spark, d):
    flat = grid(spark, d).select("precision", F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("level")) for c in DIMS])).alias("x")).select("x.dim", "x.level", "precision")
    return flat.groupBy("dim", "level").agg(r6(F.avg("precision"), "mean"), r6(F.stddev_samp("precision"), "sd"), F.count("precision").alias("n"))


@query("select round(avg(sd), 6) as sensitivity, count(sd) as n_held, sum(n) as n_values from (select load, prompt, stddev_samp(m) as sd, count(*) as n from (select load, prompt, model, avg(precision) as m from grid group by 1, 2, 3) group by 1, 2)".replace("sum(n) as n_values", "cast(sum(n) as bigint) as n_values"), **R)
def heldout_sensitivity(spark, d):
    """Spread over models with load and prompt held, on the mean."""
    m = grid(spark, d).groupBy("load", "prompt", "model").agg(F.avg("precision").alias("m"))
    s = m.groupBy("load", "prompt").agg(F.stddev_samp("m").alias("sd"), F.count(F.lit(1)).alias("n"))
    return s.agg(r6(F.avg("sd"), "sensitivity"), F.count("sd").alias("n_held"), F.sum("n").alias("n_values"))


GROUPINGS = {"repeats": ["load", "mesh"], "prompts": ["load", "mesh", "view_type"], "views": ["load", "mesh", "prompt"], "counts": ["load", "mesh", "k"]}


@query(" union all ".join(f"select '{n}' as over_what, model, round(avg(sd), 6) as stability from (select model, {', '.join(c)}, stddev_samp(recall) as sd from grid group by all) group by model" for n, c in GROUPINGS.items()), **R)
def stability(spark, d):
    """How much results vary within groups, on the mean: over all repeats, and with the view type, prompt or count held."""
    g, out = cut(grid(spark, d).select("model", "load", "mesh", "view_type", "prompt", "k", "recall")), None
    for name, columns in GROUPINGS.items():
        part = g.groupBy("model", *columns).agg(F.stddev_samp("recall").alias("sd")).groupBy("model").agg(r6(F.avg("sd"), "stability")).withColumn("over_what", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("select c.model, c.load, round(c.p, 6) as mean_p, round(c.p5, 6) as p_at_5, round(c.r, 6) as mean_r, b.meshes, round(b.points, 6) as mean_points, round(b.cells, 6) as cells_per_view from (select model, load, avg(p) as p, max(case when k = 5 then p end) as p5, avg(r) as r from (select model, load, k, avg(precision) as p, avg(recall) as r from grid group by 1, 2, 3) group by 1, 2) c join (select model, load, count(distinct mesh) as meshes, avg(n_points) as points, sum(n_matched) / sum(k) as cells from grid group by 1, 2) b on c.model = b.model and c.load = b.load", **R)
def curve_summary(spark, d):
    g, keys = grid(spark, d), ["model", "load"]
    by_k = g.groupBy(*keys, "k").agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    c = by_k.groupBy(*keys).agg(r6(F.avg("p"), "mean_p"), r6(F.max(F.when(F.col("k") == 5, F.col("p"))), "p_at_5"), r6(F.avg("r"), "mean_r"))
    return c.join(g.groupBy(*keys).agg(F.count_distinct("mesh").alias("meshes"), r6(F.avg("n_points"), "mean_points"), r6(F.sum("n_matched") / F.sum("k"), "cells_per_view")), keys)


@query("select count(*) filter (where s = 2 and nulls = 0) as kept, count(*) as total from (select mesh, model, prompt, k, count(distinct view_type) as s, count(*) filter (where precision is null) as nulls from (select mesh, model % 2 as model, prompt, k, view_type, precision from (select *, cast(floor(model / 2.0) as bigint) as half from grid)) group by 1, 2, 3, 4)".replace("model % 2 as model", "cast(floor(model / 2.0) as bigint) as model"), **R)
def paired_valid_keys(spark, d):
    from ..operators.cohort import paired_valid_keys as valid

    g = grid(spark, d).withColumn("model", F.floor(F.col("model") / 2.0))
    return valid(g, ["mesh", "model", "prompt", "k"], "view_type", "precision").agg(F.count_if("valid").alias("kept"), F.count(F.lit(1)).alias("total"))


@query("select model, prompt, cast(sum(n_matched) as bigint) as matched, cast(sum(n_points) as bigint) as points, round(sum(n_matched) / sum(n_points), 6) as precision from grid group by 1, 2", **R)
def micro_by_model(spark, d):
    return grid(spark, d).groupBy("model", "prompt").agg(F.sum("n_matched").alias("matched"), F.sum("n_points").alias("points"), r6(F.sum("n_matched") / F.sum("n_points"), "precision"))


@query("select k, round(avg(case when view_type = 0 then recall end), 6) as ortho, round(avg(case when view_type = 1 then recall end), 6) as random from grid group by 1", **R)
def view_curve(spark, d):
    g = grid(spark, d).groupBy("k").pivot("view_type", [0, 1]).agg(r6(F.avg("recall"), "m"))
    return g.select("k", F.col("0").alias("ortho"), F.col("1").alias("random"))


@query("select round(max(abs(m - round(m, 3))), 9) as most, count(*) as matched, max(abs(m - round(m, 3))) <= 0.0005 + 1e-9 as agrees from (select model, prompt, avg(precision) as m from grid group by 1, 2) where model <> 3", **R)
def regression_check(spark, d):
    """The largest difference of a table from the one that was published (here: written as CSV before, with three digits and
    without one model), over the rows that both have."""
    from ..sources.files import write_table

    g = cut(grid(spark, d).groupBy("model", "prompt").agg(F.avg("precision").alias("mean")))
    path = new_folder(spark, "published")
    write_table(g.where("model <> 3").select("model", "prompt", F.round("mean", 3).alias("published")), path, "csv")
    given = spark.read.schema("model long, prompt long, published double").option("header", True).csv(path)
    most = F.max(F.abs(F.col("mean") - F.col("published")))
    return g.join(given, ["model", "prompt"]).agg(F.round(most, 9).alias("most"), F.count(F.lit(1)).alias("matched"), (most <= 0.0005 + 1e-9).alias("agrees"))


@query("select object, load_case, round(log10(greatest(max(en), 1e-12)), 6) as size, array_to_string([cast(case when load_case = l then 1 else 0 end as varchar) for l in ['bending', 'compression', 'torsion']], '') as one_hot from trials group by object, load_case", trials=TRIALS)
def unit_features(spark, d):
    hot = F.concat(*[F.when(F.col("load_case") == x, "1").otherwise("0") for x in ("bending", "compression", "torsion")])
    return trials(spark, d).groupBy("object", "load_case").agg(r6(F.log10(F.greatest(F.max("en"), F.lit(1e-12))), "size")).withColumn("one_hot", hot)


@query("select object, view from (select object, view, row_number() over (partition by object order by md5('5|' || cast(view as varchar)), view) as r from views where view % 11 <> 0) where r <= 4", **W)
def random_views(spark, d):
    """Four views of each object in random order that doesn't change, without those ruled out."""
    v = views(spark, d).select("object", "view")
    out = v.where("view % 11 = 0")
    w = Window.partitionBy("object").orderBy(K.hash_order("view", seed=5), "view")
    return v.join(out, ["object", "view"], "left_anti").withColumn("r", F.row_number().over(w)).where("r <= 4").select("object", "view")


@query("select cast(floor(score * 4) as bigint) as col, cast(floor((az % 90) / 30) as bigint) as row, count(*) as n from views where (cast(floor(score * 4) as bigint) + cast(floor((az % 90) / 30) as bigint)) % 3 <> 0 group by 1, 2", **W)
def rejected_cells(spark, d):
    """Points whose grid cell isn't among the rejected ones: cell numbers by arithmetic, then an anti join."""
    p = views(spark, d).select("view", F.floor(F.col("score") * 4).cast("long").alias("col"), F.floor((F.col("az") % 90) / 30).cast("long").alias("row"))
    bad = p.where((F.col("col") + F.col("row")) % 3 == 0).select("col", "row").distinct()
    return p.join(bad, ["col", "row"], "left_anti").groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"))
