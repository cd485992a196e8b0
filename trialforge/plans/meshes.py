"""Queries over tetrahedra and triangle meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges as O
from ..operators import robust as R
from ..operators import select as K
from ..operators import spatial as S
from ..sources.tables import cut
from .registry import query

TETS = "select vec_id, label as object, c, " + ", ".join(f"cast(embedding[12 * c + {3 * n + k + 1}] as double) as {a}{n}" for n in range(4) for k, a in enumerate("xyz")) + " from embeddings cross join range(0, 5) t(c)"
DET = "((x1 - x0) * ((y2 - y0) * (z3 - z0) - (z2 - z0) * (y3 - y0)) - (y1 - y0) * ((x2 - x0) * (z3 - z0) - (z2 - z0) * (x3 - x0)) + (z1 - z0) * ((x2 - x0) * (y3 - y0) - (y2 - y0) * (x3 - x0)))"
GEO = f"select vec_id, object, c, (x0 + x1 + x2 + x3) / 4 as cx, (y0 + y1 + y2 + y3) / 4 as cy, (z0 + z1 + z2 + z3) / 4 as cz, abs({DET}) / 6 as volume from tets"
T1 = {"tets": TETS, "geo": GEO}
VERTICES = "select vec_id as i, generate_subscripts(embedding, 1) - 1 as j, cast(unnest(embedding) as double) as z from embeddings"
FACES = """select cast(floor(i / 50) as bigint) as object, 2 * (i * 64 + j) as face, i * 64 + j as a, (i + 1) * 64 + j as b, i * 64 + j + 1 as c from grid union all
 select cast(floor(i / 50) as bigint), 2 * (i * 64 + j) + 1, (i + 1) * 64 + j, (i + 1) * 64 + j + 1, i * 64 + j + 1 from grid"""
GRID = "select i, j from vertices where j < 63 and i < (select max(i) from vertices)"
EDGES = "select object, face, least(u, v) as u, greatest(u, v) as v from (select object, face, a as u, b as v from faces union all select object, face, b, c from faces union all select object, face, c, a from faces)"
M1 = {"vertices": VERTICES, "grid": GRID, "faces": FACES, "edges": EDGES}
CORNER = "select f.object, f.face, " + ", ".join(f"{p}.i as {p}_x, {p}.j as {p}_y, {p}.z as {p}_z" for p in "abc") + " from faces f join vertices a on a.i * 64 + a.j = f.a join vertices b on b.i * 64 + b.j = f.b join vertices c on c.i * 64 + c.j = f.c"
NORMAL = "select object, face, (a_x + b_x + c_x) / 3.0 as mx, (a_y + b_y + c_y) / 3.0 as my, (a_z + b_z + c_z) / 3.0 as mz, nx / l as nx, ny / l as ny, nz / l as nz from (select *, sqrt(nx * nx + ny * ny + nz * nz) as l from (select *, (b_y - a_y) * (c_z - a_z) - (b_z - a_z) * (c_y - a_y) as nx, (b_z - a_z) * (c_x - a_x) - (b_x - a_x) * (c_z - a_z) as ny, (b_x - a_x) * (c_y - a_y) - (b_y - a_y) * (c_x - a_x) as nz from corner))"
HINGE = "select e.object, e.u, e.v, e.f1, e.f2, n1.nx * n2.nx + n1.ny * n2.ny + n1.nz * n2.nz as cosine, (n2.mx - n1.mx) * n1.nx + (n2.my - n1.my) * n1.ny + (n2.mz - n1.mz) * n1.nz as inward from (select object, u, v, min(face) as f1, max(face) as f2 from edges group by object, u, v having count(*) = 2) e join normals n1 on n1.face = e.f1 join normals n2 on n2.face = e.f2"
N1 = M1 | {"corner": CORNER, "normals": NORMAL, "hinges": HINGE}


def tets(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").alias("object"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c"))
    x = [F.get("embedding", 12 * F.col("c") + i).cast("double").alias(f"{'xyz'[i % 3]}{i // 3}") for i in range(12)]
    return e.select("vec_id", "object", "c", *x)


def geometry(t: DataFrame) -> DataFrame:
    """Centroid and volume of tetrahedra, by column algebra."""
    side = {f"{a}{n}": F.col(f"{a}{n}") - F.col(f"{a}0") for a in "xyz" for n in (1, 2, 3)}
    minor = lambda a, b: side[f"{a}2"] * side[f"{b}3"] - side[f"{b}2"] * side[f"{a}3"]
    det = side["x1"] * minor("y", "z") - side["y1"] * minor("x", "z") + side["z1"] * minor("x", "y")
    centre = {f"c{a}": sum((F.col(f"{a}{n}") for n in (1, 2, 3)), F.col(f"{a}0")) / 4 for a in "xyz"}
    return t.select("vec_id", "object", "c", *[v.alias(k) for k, v in centre.items()], (F.abs(det) / 6).alias("volume"))


def vertices(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "z")).withColumn("z", F.col("z").cast("double"))


def triangles(spark, d) -> DataFrame:
    """(object, face, a, b, c, pa, pb, pc): numbers and places of the corners. Each row of heights meets the next one once."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").alias("h"))
    rows = e.join(e.select((F.col("i") - 1).alias("i"), F.col("h").alias("next")), "i")
    g = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(125)))).withColumns({"j": F.shiftright("q", 1), "k": F.col("q") % 2})
    i, j, k, n = F.col("i"), F.col("j"), F.col("k"), F.col("i") * 64 + F.shiftright("q", 1)
    place = lambda x, y, z: F.array(*[v.cast("double") for v in (x, y, z)])
    return g.select(
        F.floor(i / 50).cast("long").alias("object"), (2 * n + k).alias("face"), (n + 64 * k).alias("a"), (n + 64 + k).alias("b"), (n + 1).alias("c"),
        place(i + k, j, F.when(k == 0, F.get("h", j)).otherwise(F.get("next", j))).alias("pa"), place(i + 1, j + k, F.get("next", j + k)).alias("pb"), place(i, j + 1, F.get("h", j + 1)).alias("pc"),
    )


#: The corners' places, a column for each coordinate: Spark shuffles and stores those with less than arrays.
FLAT = [f"{q}{i}" for q in "abc" for i in range(3)]


def flat(t: DataFrame) -> DataFrame:
    """Triangles with their corners' places as FLAT."""
    return t.select("object", "face", "a", "b", "c", *[F.col(f"p{c[0]}")[int(c[1])].alias(c) for c in FLAT])


def vector(name: str) -> Column:
    """Columns of one name, numbered from 0 to 2, as an array; reading an item of it costs no array."""
    return F.array(*[F.col(f"{name}{i}") for i in range(3)])


def adjacency(f: DataFrame, carry: list[str] | None = None, ends: bool = False, alone: bool = False) -> DataFrame:
    """(object, u, v, f1, f2): edges that two faces of an object share; f1 and f2 are structs of face and the columns in
    carry. Faces meet at their edge with all they carry, each once, so nothing is joined back to them. ends: faces have
    FLAT, and the edge's ends come as u0 to v2. alone: edges of other numbers of faces come, too, with a null f2."""
    sides = [("a", "b"), ("b", "c"), ("c", "a")]
    at = lambda p, q, end, i: F.when((F.col(p) <= F.col(q)) == F.lit(end == "u"), F.col(f"{p}{i}")).otherwise(F.col(f"{q}{i}"))
    places = [f"{end}{i}" for end in "uv" for i in range(3)] if ends else []
    edge = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"), *[at(p, q, x[0], int(x[1])).alias(x) for x in places])
    carried = ["face", *(carry or [])]
    e = f.select("object", *[F.col(c).alias(f"__{c}") for c in carried], F.explode(F.array(*[edge(*x) for x in sides])).alias("e")).select("object", "e.*", *[f"__{c}" for c in carried])
    met = Window.partitionBy("object", "u", "v").orderBy("__face")
    e = e.withColumns({"k": F.row_number().over(met), "third": F.lead("__face", 2).over(met), **{f"next__{c}": F.lead(f"__{c}").over(met) for c in carried}})
    two = F.col("next__face").isNotNull() & F.col("third").isNull()
    first, second = (F.struct(*[F.col(f"{x}__{c}").alias(c) for c in carried]) for x in ("", "next"))
    e = e.where(F.col("k") == 1) if alone else e.where((F.col("k") == 1) & two)
    return e.select("object", "u", "v", *places, first.alias("f1"), (F.when(two, second) if alone else second).alias("f2"))


def with_normals(t: DataFrame) -> DataFrame:
    """Triangles as of flat() with their centre (m0 to m2), unit normal (n0 to n2) and twice their area (area2)."""
    s = lambda q, i: F.col(f"{q}{i % 3}") - F.col(f"a{i % 3}")
    t = t.withColumns({f"n{i}": s("b", i + 1) * s("c", i + 2) - s("b", i + 2) * s("c", i + 1) for i in range(3)} | {f"m{i}": (F.col(f"a{i}") + F.col(f"b{i}") + F.col(f"c{i}")) / 3 for i in range(3)})
    return t.withColumn("area2", F.sqrt(dot(vector("n"), vector("n")))).withColumns({f"n{i}": F.col(f"n{i}") / F.col("area2") for i in range(3)})


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return sum((a[i] * b[i] for i in range(3)), F.lit(0.0))


def minus(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.array(*[a[i] - b[i] for i in range(3)])


def hinges(spark, d, corners: bool = False) -> DataFrame:
    """Adjacent faces with the cosine between their normals, how far the second one's centre lies before the first, the
    length of their edge, its ends and both centres; corners: the faces' corners and areas (t1, t2), too."""
    return hinges_of(triangles(spark, d), corners)


def hinges_of(t: DataFrame, corners: bool = False, alone: bool = False) -> DataFrame:
    """hinges() of triangles. Faces bring what is asked for, which is worked out once for each, before they meet; alone:
    edges of other numbers of faces come, too, without f2."""
    n, m = ([f"{x}{i}" for i in range(3)] for x in "nm")
    more = [*FLAT, "area2"] if corners else []
    j = adjacency(with_normals(flat(t)), [*n, *m, *more], ends=True, alone=alone)
    part = lambda f, x: F.array(*[F.col(f"{f}.{x}{i}") for i in range(3)])
    side = minus(vector("u"), vector("v"))
    held = [F.struct(F.col(f"{f}.face").alias("face"), *[part(f, q).alias(f"p{q}") for q in "abc"], F.col(f"{f}.area2").alias("area2")).alias(f"t{f[1]}") for f in ("f1", "f2")] if corners else []
    return j.select(
        "object", F.col("f1.face").alias("f1"), F.col("f2.face").alias("f2"), dot(part("f1", "n"), part("f2", "n")).alias("cosine"), dot(minus(part("f2", "m"), part("f1", "m")), part("f1", "n")).alias("inward"),
        F.sqrt(dot(side, side)).alias("length"), vector("u").alias("pu"), vector("v").alias("pv"), part("f1", "m").alias("m1"), part("f2", "m").alias("m2"), *held,
    )


def angle(low: float, high: float) -> Column:
    """Angles over `low` and up to `high` degrees, by cosine."""
    import math

    return (F.col("cosine") < math.cos(math.radians(low))) & (F.col("cosine") >= math.cos(math.radians(high)))


@query("select object, count(*) as n, round(sum(volume), 6) as volume, round(avg(cbrt(volume)), 6) as size, round(avg(cx), 6) as cx from geo group by 1", **T1)
def tet_geometry(spark, d):
    return geometry(tets(spark, d)).groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 6).alias("volume"), F.round(F.avg(F.cbrt("volume")), 6).alias("size"), F.round(F.avg("cx"), 6).alias("cx"))


NEAR = 0.15
HOT = "select object, cx, cy, cz from (select *, quantile_cont(volume, 0.95) over (partition by object) as q from geo) where volume >= q"
CLOSE = f"(g.cx - a.cx) * (g.cx - a.cx) + (g.cy - a.cy) * (g.cy - a.cy) + (g.cz - a.cz) * (g.cz - a.cz) <= {NEAR * NEAR}"
CUT = 1.25 * NEAR / 4
T2 = T1 | {"hot": HOT, "fine": f"select * from geo where cbrt(volume) <= {CUT}"}


def centres(spark, d) -> tuple[DataFrame, DataFrame]:
    """Elements by centre and size, and the largest twentieth of each object, which stand for its hot points."""
    g = cut(geometry(tets(spark, d)).select("object", "vec_id", "c", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), F.col("volume").alias("v"), F.cbrt("volume").alias("h")))
    return g, cut(S.percentile_cut(g, ["object"], "v", 0.95))


@query(f"select object, round(quantile_cont(case when near then h end, 0.5), 6) as h_loc, round(quantile_cont(h, 0.5), 6) as h_glob, count(*) filter (where near) as n_loc, count(*) as n_tot, any_value((select count(*) from hot g where g.object = e.object)) as n_gt from (select object, cbrt(volume) as h, exists (select 1 from hot g where g.object = a.object and {CLOSE}) as near from geo a) e group by 1", **T2)
def hotspot_elemsize(spark, d):
    """The median size of elements near hot points and of all; null where none is near."""
    g, hot = centres(spark, d)
    near = S.within_radius(g, hot, ["object"], NEAR)
    glob = R.summary(g, ["object"], {"n_tot": F.count(F.lit(1))}, {"h_glob": ("h", 0.5)})
    loc = R.summary(near, ["object"], {"n_loc": F.count(F.lit(1))}, {"h_loc": ("h", 0.5)})
    out = glob.join(loc, "object", "left").join(hot.groupBy("object").agg(F.count(F.lit(1)).alias("n_gt")), "object")
    return out.select("object", F.round("h_loc", 6).alias("h_loc"), F.round("h_glob", 6).alias("h_glob"), F.coalesce("n_loc", F.lit(0)).alias("n_loc"), "n_tot", "n_gt")


@query(f"select object, n_fine, n_gt, round(prec, 6) as prec, round(rec, 6) as rec, round(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0 end, 6) as f1 from (select object, n_gt, coalesce(n_fine, 0) as n_fine, m_f / n_fine as prec, m_g / n_gt as rec from (select g.object, count(*) as n_gt, count(*) filter (where exists (select 1 from fine a where g.object = a.object and {CLOSE})) as m_g from hot g group by 1) left join (select a.object, count(*) as n_fine, count(*) filter (where exists (select 1 from hot g where g.object = a.object and {CLOSE})) as m_f from fine a group by 1) using (object))", **T2)
def element_prf(spark, d):
    """Fine elements against hot points, both ways: precision is null without fine elements, recall and F1 are 0."""
    g, hot = centres(spark, d)
    fine = g.where(F.col("h") <= CUT)
    count = lambda df, name: df.groupBy("object").agg(F.count(F.lit(1)).alias(name))
    n = count(hot, "n_gt").join(count(fine, "n_fine"), "object", "left")
    n = n.join(count(S.within_radius(fine, hot, ["object"], NEAR), "m_f"), "object", "left").join(count(S.within_radius(hot, fine, ["object"], NEAR), "m_g"), "object", "left").fillna(0)
    p, r = F.when(F.col("n_fine") > 0, F.col("m_f") / F.col("n_fine")), F.col("m_g") / F.col("n_gt")
    return n.select("object", "n_fine", "n_gt", F.round(p, 6).alias("prec"), F.round(r, 6).alias("rec"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


@query("select object, count(*) as n, sum(f1) as s1, sum(f2) as s2 from (select object, min(face) as f1, max(face) as f2 from edges group by object, u, v having count(*) = 2) group by 1", **M1)
def face_adjacency(spark, d):
    a = adjacency(triangles(spark, d))
    return a.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.sum("f1.face").alias("s1"), F.sum("f2.face").alias("s2"))


@query("select h.object, count(*) as n, round(avg(cosine), 6) as mean_cosine, cast(sum(greatest(2, cast(ceil(sqrt((p.i - q.i) * (p.i - q.i) + (p.j - q.j) * (p.j - q.j) + (p.z - q.z) * (p.z - q.z)) / 0.5) as bigint))) as bigint) as samples from hinges h join vertices p on p.i * 64 + p.j = h.u join vertices q on q.i * 64 + q.j = h.v where cosine < cos(radians(8)) and inward > 0 group by 1", **N1)
def concave_edges(spark, d):
    """Sharp edges that bend inwards, and how many points along them max(2, length / spacing) makes."""
    h = hinges(spark, d).where(angle(8.0, 180.0) & (F.col("inward") > 0))
    samples = F.sum(F.greatest(F.lit(2), F.ceil(F.col("length") / 0.5).cast("int")))
    return h.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cosine"), 6).alias("mean_cosine"), samples.alias("samples"))


EDGE_POINTS = """select h.object, p.i + (q.i - p.i) * k / (n - 1.0) as x, p.j + (q.j - p.j) * k / (n - 1.0) as y, p.z + (q.z - p.z) * k / (n - 1.0) as z from (select h.*, greatest(2, cast(ceil(sqrt((p.i - q.i) * (p.i - q.i) + (p.j - q.j) * (p.j - q.j) + (p.z - q.z) * (p.z - q.z)) / 0.5) as bigint)) as n, p, q
  from hinges h join vertices p on p.i * 64 + p.j = h.u join vertices q on q.i * 64 + q.j = h.v where cosine < cos(radians(8)) and inward > 0) h cross join range(0, 64) t(k) where k < n"""
FACE_POINTS = "select object, (a_x + b_x + c_x) / 3.0 as x, (a_y + b_y + c_y) / 3.0 as y, (a_z + b_z + c_z) / 3.0 as z from corner where face in (select unnest([f1, f2]) from hinges where cosine < cos(radians(8)) and inward > 0)"


@query("select object, count(*) as anchors, count(*) > 1000 as dense from (select distinct object, round(x, 4), round(y, 4), round(z, 4) from (select * from edge_points union all select * from face_points)) group by 1", **N1, edge_points=EDGE_POINTS, face_points=FACE_POINTS)
def density_screen(spark, d):
    """How many different anchors an object would get along its sharp concave edges and on the faces beside them, and whether
    these are too many, before anything is worked out on them."""
    h = cut(hinges(spark, d).where(angle(8.0, 180.0) & (F.col("inward") > 0)).select("object", "pu", "pv", "length", "m1", "m2"))
    n = F.greatest(F.lit(2), F.ceil(F.col("length") / 0.5).cast("int"))
    along = h.select("object", "pu", "pv", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    along = along.select("object", F.array(*[F.col("pu")[i] + (F.col("pv")[i] - F.col("pu")[i]) * F.col("k") / (F.col("n") - 1) for i in range(3)]).alias("p"))
    beside = h.select("object", F.explode(F.array("m1", "m2")).alias("p"))
    p = along.unionByName(beside).select("object", F.transform("p", lambda x: F.round(x, 4)).alias("p")).distinct()
    return p.groupBy("object").agg(F.count(F.lit(1)).alias("anchors")).withColumn("dense", F.col("anchors") > 1000)


def anchors_along(h: DataFrame, spacing: DataFrame) -> DataFrame:
    """(object, f1, f2, k, x, y, z, near): points along the edges of hinges, max(2, length / spacing) on each; near is that
    of spacing(object, spacing, near)."""
    h = h.join(spacing, "object")
    n = F.greatest(F.lit(2), F.ceil(F.col("length") / F.col("spacing")).cast("int"))
    ends = [F.col(f"p{end}")[i].alias(f"{end}{i}") for end in "uv" for i in range(3)]
    along = h.select("object", "f1", "f2", "near", *ends, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    at = lambda i: F.col(f"u{i}") + (F.col(f"v{i}") - F.col(f"u{i}")) * F.col("k") / (F.col("n") - 1)
    return along.select("object", "f1", "f2", "k", *[at(i).alias(a) for i, a in enumerate("xyz")], "near")


def anchors_on(t: DataFrame, spacing: DataFrame) -> DataFrame:
    """(object, k, face, x, y, z): area_samples of triangles with areas, ceil(area / spacing ** 2) for each object."""
    t = cut(t.select("object", "face", "pa", "pb", "pc", F.floor(F.col("area2") / 2 * 1000000).cast("long").alias("units")))
    total = t.groupBy("object").agg(F.sum("units").alias("total")).where("total > 0").join(spacing.select("object", "spacing"), "object")
    n = F.ceil(F.col("total") / (1000000 * F.col("spacing") * F.col("spacing"))).cast("int")
    k = total.select("object", "total", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    u = lambda seed: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("object").cast("string"), F.col("k").cast("string"), F.lit(str(seed))).cast("binary")), 1, 7), 16, 10).cast("double") / float(1 << 28)
    draws = k.select("object", F.col("k").cast("long").alias("k"), F.floor(u(0) * F.col("total")).cast("long").alias("place"), F.sqrt(u(1)).alias("r"), u(2).alias("t"))
    r = O.items_at(draws, t.select("object", "face", "units"), ["object"], "face", "units").join(t, ["object", "face"])
    w = {"a": 1 - F.col("r"), "b": F.col("r") * (1 - F.col("t")), "c": F.col("r") * F.col("t")}
    return r.select("object", "k", "face", *[sum((w[q] * F.col(f"p{q}")[i] for q in "abc"), F.lit(0.0)).alias(a) for i, a in enumerate("xyz")])


def screen_parts(t: DataFrame, sharp: float, smooth: float, most: int) -> DataFrame:
    """triangles -> (object, anchors, volume, dense): how many anchors each object would get along its sharp concave edges and
    on its smooth concave faces, at a spacing that follows from its diagonal, each set thinned in order, both together
    without repeats (four decimals); its volume, -1 where it isn't closed; and whether the anchors are over `most`."""
    t = cut(flat(t))
    pa, pb, pc = (vector(x) for x in "abc")
    # of each corner triple: a . (b x c) / 6
    six = sum((pa[i] * (pb[(i + 1) % 3] * pc[(i + 2) % 3] - pb[(i + 2) % 3] * pc[(i + 1) % 3]) for i in range(3)), F.lit(0.0))
    ends = [f(g(pa[i], pb[i], pc[i])).alias(f"{n}{i}") for i in range(3) for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))]
    diagonal = F.sqrt(sum(((F.col(f"hi{i}") - F.col(f"lo{i}")) * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(3)), F.lit(0.0)))
    whole = t.groupBy("object").agg((F.sum(six) / 6).alias("inside"), *ends)
    whole = cut(whole.select("object", "inside", (diagonal / (66.667 * 2)).alias("spacing")).withColumn("near", 0.75 * F.col("spacing")))
    spacing = whole.select("object", "spacing", "near")
    t = t.select("object", "face", "a", "b", "c", *[vector(q).alias(f"p{q}") for q in "abc"])
    # one pass over the edges: hinges that bend inwards, and edges that aren't those of two faces
    places = [F.col(f"p{end}")[i].alias(f"{end}{i}") for end in "uv" for i in range(3)]
    met = cut(hinges_of(t, alone=True).where((F.col("inward") > 0) | F.col("f2").isNull()).select("object", "f1", "f2", "cosine", "length", *places))
    h = met.where(F.col("f2").isNotNull()).select("object", "f1", "f2", "cosine", "length", vector("u").alias("pu"), vector("v").alias("pv"))
    thin = lambda p, *order: K.spread(p, ["object"], [F.col(c) for c in order], "near")
    along = thin(anchors_along(h.where(angle(sharp, 180.0)), spacing), "f1", "f2", "k")
    faces = h.where(angle(smooth, sharp)).select("object", F.explode(F.array("f1", "f2")).alias("face")).distinct()
    beside = with_normals(flat(t.join(faces, ["object", "face"], "left_semi"))).select("object", "face", *[vector(q).alias(f"p{q}") for q in "abc"], "area2")
    on = thin(anchors_on(beside, spacing).join(spacing.select("object", "near"), "object"), "k")
    anchors = [p.select("object", *[F.round(a, 4).alias(a) for a in "xyz"]) for p in (along, on)]
    n = anchors[0].unionByName(anchors[1]).distinct().groupBy("object").agg(F.count(F.lit(1)).alias("anchors"))
    open_edges = met.where(F.col("f2").isNull()).select("object").distinct()
    volume = whole.select("object", "inside").join(open_edges.withColumn("open", F.lit(True)), "object", "left")
    out = volume.join(n, "object", "left").select("object", F.coalesce("anchors", F.lit(0)).alias("anchors"), F.when(F.col("open"), -1.0).otherwise(F.abs("inside")).alias("volume"))
    return out.withColumn("dense", F.col("anchors") > most)


@query()
def dense_parts(spark, d):
    """screen_parts of all objects; SQL would have to walk through each object's points, so a plain version is in the tests."""
    return screen_parts(triangles(spark, d), 8.0, 1.0, 1000)


@query("select object, count(distinct f) as n from (select object, unnest([f1, f2]) as f from hinges where cosine < cos(radians(1)) and cosine >= cos(radians(5)) and inward > 0) group by 1", **N1)
def concave_faces(spark, d):
    h = hinges(spark, d).where(angle(1.0, 5.0) & (F.col("inward") > 0))
    return h.select("object", F.explode(F.array("f1", "f2")).alias("f")).groupBy("object").agg(F.count_distinct("f").alias("n"))


@query("select v.i, v.j from vertices v where v.i * 64 + v.j not in (select u from edges where face % 7 <> 0 union select v from edges where face % 7 <> 0)", **M1)
def mesh_integrity(spark, d):
    """Vertices that no face uses once every seventh face is gone."""
    used = triangles(spark, d).where("face % 7 <> 0").select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    return vertices(spark, d).withColumn("id", F.col("i") * 64 + F.col("j")).join(used, "id", "left_anti").select("i", "j")


STATUS = "select object, n_field, n_deg, n_nan, case when n_deg <> n_field then 'SHAPE_MISMATCH' when n_nan > 0 then 'NAN_SIZING_FIELD' else 'ok' end as status from (select object, count(*) as n_field, cast(sum(used) as bigint) as n_deg, cast(sum(bad) as bigint) as n_nan from (select object, id, max(case when object % 3 > 0 or face % 7 <> 0 then 1 else 0 end) as used, max(case when object % 3 = 1 and id % 977 = 5 then 1 else 0 end) as bad from (select object, face, unnest([a, b, c]) as id from faces) group by 1, 2) group by 1)"


@query(STATUS, **M1)
def mesh_status(spark, d):
    """Whether each vertex with a size has an edge and each size is a number: some objects lack every seventh face, others
    some sizes."""
    v = triangles(spark, d).select("object", "face", F.explode(F.array("a", "b", "c")).alias("id"))
    there = (F.col("object") % 3 > 0) | (F.col("face") % 7 != 0)
    field = F.when((F.col("object") % 3 == 1) & (F.col("id") % 977 == 5), F.lit(float("nan"))).otherwise(1.0)
    by = v.groupBy("object", "id").agg(F.bool_or(there).alias("used"), F.first(field).alias("field"))
    n = by.groupBy("object").agg(F.count(F.lit(1)).alias("n_field"), F.count_if("used").alias("n_deg"), F.count_if(F.isnan("field")).alias("n_nan"))
    return n.withColumn("status", F.when(F.col("n_deg") != F.col("n_field"), "SHAPE_MISMATCH").when(F.col("n_nan") > 0, "NAN_SIZING_FIELD").otherwise("ok"))


@query("select object, level, round(level * h, 6) as h_max, round(level * h / 5, 6) as h_min, round(4 * h / 5, 6) as radius, round(pow(8.485 * v / n, 1.0 / 3), 6) as floor_size from (select object, sum(volume) as v, count(*) as n, case when object = 3 then 2.5 else 20 * pow(sum(volume) / 268, 0.4) end as h from geo group by 1) cross join (select unnest([1.0e0, 1.25e0, 1.6e0, 2.0e0]) as level)", **T1)
def size_law(spark, d):
    """Sizes by a power law of an object's volume, unless a table of overrides has one; levels scale them, but the radius
    stays that of four least sizes at level 1."""
    own = spark.createDataFrame([(3, 2.5)], "object int, own double")
    g = geometry(tets(spark, d)).groupBy("object").agg(F.sum("volume").alias("v"), F.count(F.lit(1)).alias("n"))
    h = F.coalesce("own", 20 * F.pow(F.col("v") / 268, F.lit(0.4)))
    s = g.join(F.broadcast(own), "object", "left").withColumn("h", h).withColumn("level", F.explode(F.array(*[F.lit(x) for x in (1.0, 1.25, 1.6, 2.0)])))
    sized = F.col("level") * F.col("h")
    return s.select("object", "level", F.round(sized, 6).alias("h_max"), F.round(sized / 5, 6).alias("h_min"), F.round(4 * F.col("h") / 5, 6).alias("radius"), F.round(F.pow(8.485 * F.col("v") / F.col("n"), F.lit(1.0 / 3)), 6).alias("floor_size"))


@query("select object, n as faces, round(greatest(x, y, z) / least(x, y, z), 6) as aspect from (select f.object, count(distinct face) as n, max(i) - min(i) as x, max(j) - min(j) as y, max(z) - min(z) as z from (select object, face, unnest([a, b, c]) as id from faces) f join vertices v on v.i * 64 + v.j = f.id group by 1) where n >= 200 and least(x, y, z) > 0 and greatest(x, y, z) / least(x, y, z) <= 200", **M1)
def shape_validity(spark, d):
    """Objects with enough faces, some extent and no extreme aspect."""
    p = triangles(spark, d).select("object", F.array("pa", "pb", "pc").alias("p"))
    axis = lambda i: F.array(*[F.col("p")[k][i] for k in range(3)])
    ends = [f(axis(i)).alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.array_min), ("hi", F.array_max))]
    limits = [x for i in range(3) for x in (F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"))]
    size = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(3)]
    g = p.select("object", *ends).groupBy("object").agg(F.count(F.lit(1)).alias("faces"), *limits).select("object", "faces", F.greatest(*size).alias("most"), F.least(*size).alias("least"))
    return g.where("faces >= 200 and least > 0 and most / least <= 200").select("object", "faces", F.round(F.col("most") / F.col("least"), 6).alias("aspect"))


@query("select object, sum(greatest(2, cast(ceil(sqrt((ai - bi) * (ai - bi) + (aj - bj) * (aj - bj) + (az - bz) * (az - bz)) / 0.5) as bigint))) as samples from (select e.object, p.i as ai, p.j as aj, p.z as az, q.i as bi, q.j as bj, q.z as bz from (select object, u, v from edges group by 1, 2, 3 having count(*) = 2) e join vertices p on p.i * 64 + p.j = e.u join vertices q on q.i * 64 + q.j = e.v) group by 1".replace("sum(greatest", "cast(sum(greatest").replace("as bigint))) as samples", "as bigint))) as bigint) as samples"), **M1)
def edge_samples(spark, d):
    """Points along shared edges, max(2, length / spacing) on each."""
    t = triangles(spark, d).withColumn("at", F.array(*[F.struct(F.col(x).alias("id"), F.col(f"p{x}").alias("p")) for x in "abc"]))
    place = lambda v: F.get(F.filter("f1.at", lambda x: x["id"] == F.col(v)), F.lit(0))["p"]
    e = adjacency(t, ["at"]).select("object", place("u").alias("pu"), place("v").alias("pv")).withColumn("side", minus("pu", "pv"))
    n = F.greatest(F.lit(2), F.ceil(F.sqrt(dot("side", "side")) / 0.5).cast("int"))
    points = e.select("object", "pu", "pv", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    points = points.select("object", *[(F.col("pu")[i] + (F.col("pv")[i] - F.col("pu")[i]) * F.col("k") / (F.col("n") - 1)).alias(a) for i, a in enumerate("xyz")])
    return points.groupBy("object").agg(F.count(F.lit(1)).alias("samples"))


CHANCE = "cast(cast('0x' || substr(md5(cast(object as varchar) || '|' || cast(k as varchar) || '|{}'), 1, 7) as bigint) as double) / 268435456"
AREAS = "select *, cast(floor(sqrt(pow((b_y - a_y) * (c_z - a_z) - (b_z - a_z) * (c_y - a_y), 2) + pow((b_z - a_z) * (c_x - a_x) - (b_x - a_x) * (c_z - a_z), 2) + pow((b_x - a_x) * (c_y - a_y) - (b_y - a_y) * (c_x - a_x), 2)) / 2 * 1000000) as bigint) as units from corner where face in (select unnest([f1, f2]) from hinges where cosine < cos(radians(1)) and cosine >= cos(radians(5)) and inward > 0)"
LAID = "select *, sum(units) over (partition by object order by face) - units as start, sum(units) over (partition by object) as total from areas"
DRAWN = f"select object, k, cast(floor({CHANCE.format(0)} * total) as bigint) as place, sqrt({CHANCE.format(1)}) as r, {CHANCE.format(2)} as t from (select object, total, unnest(range(0, cast(ceil(total / 250000.0e0) as bigint))) as k from (select object, max(total) as total from laid group by 1))"


@query("select d.object, face, k, " + ", ".join(f"round((1 - r) * a_{x} + r * (1 - t) * b_{x} + r * t * c_{x}, 6) as {x}" for x in "xyz") + " from drawn d join laid l on l.object = d.object and d.place >= l.start and d.place < l.start + l.units", **N1, areas=AREAS, laid=LAID, drawn=DRAWN)
def area_samples(spark, d):
    """Random points on an object's concave faces: ceil(area / spacing ** 2) draws, which fall on faces by their areas, at
    barycentric weights; all chances are seeded hashes of the draw. Areas count in millionths, as whole numbers."""
    h = hinges(spark, d, corners=True).where(angle(1.0, 5.0) & (F.col("inward") > 0))
    concave = h.select("object", F.explode(F.array("t1", "t2")).alias("t")).select("object", "t.*").dropDuplicates(["object", "face"])
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).cast("long").alias("object")).distinct()
    r = anchors_on(concave, rows.withColumn("spacing", F.lit(0.5)))
    return r.select("object", "face", "k", *[F.round(a, 6).alias(a) for a in "xyz"])
