"""Selections, clusters and ordered joins that work in rounds or over ranges, held against plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.operators import components, ranges, robust, select, spatial
from trialforge.streaming import shards


def cloud(rng, n, size, units=3, whole=True):
    xyz = rng.integers(-size, size, (n, 3)).astype(float) if whole else rng.random((n, 3)) * size
    return [(int(u) if u else None, i, *map(float, p), float(v)) for i, (u, p, v) in enumerate(zip(rng.integers(0, units, n), xyz, rng.integers(0, 9, n), strict=True))]


POINT = "u long, pid long, x double, y double, z double, val double"


def plain_spread(rows, key, radius, most=None):
    kept = []
    for r in sorted(rows, key=key):
        if most is not None and len(kept) == most:
            break
        if all(sum((r[k] - q[k]) ** 2 for k in (2, 3, 4)) > radius * radius for q in kept):
            kept.append(r)
    return [(r[1], i) for i, r in enumerate(kept, 1)]


@pytest.mark.parametrize(("n", "size", "radius"), [(300, 6, 2.0), (120, 40, 30.0), (0, 5, 1.0)])
def test_spread_keeps_what_the_walk_keeps(spark, n, size, radius):
    rng = np.random.default_rng(n + size)
    rows = cloud(rng, n, size)
    df = spark.createDataFrame(rows, POINT)
    units = {r[0] for r in rows}
    of = lambda u: [r for r in rows if r[0] == u]
    got = select.spread(df, ["u"], [F.col("pid")], radius)
    assert got.columns == [*df.columns, "seq"]
    assert sorted((r.pid, r.seq) for r in got.collect()) == sorted(x for u in units for x in plain_spread(of(u), lambda r: r[1], radius))
    limits = {u: int(rng.integers(1, 6)) for u in units if u != 1}
    most = spark.createDataFrame(list(limits.items()), "u long, n long")
    got = select.spread(df.withColumn("r", F.lit(radius)), ["u"], [-F.col("val"), F.col("pid")], "r", most)
    want = sorted(x for u in units for x in plain_spread(of(u), lambda r: (-r[5], r[1]), radius, limits.get(u)))
    assert sorted((r.pid, r.seq) for r in got.collect()) == want


def test_spread_of_a_chain_and_of_a_crowd(spark):
    chain = [(0, i, 0.9 * i, 0.0, 0.0, 0.0) for i in range(12)]
    crowd = [(5, 100 + i, 0.001 * i, 0.0, 0.0, 0.0) for i in range(400)]
    got = select.spread(spark.createDataFrame(chain + crowd, POINT), ["u"], [F.col("pid")], 1.0).collect()
    assert sorted(r.pid for r in got) == [0, 2, 4, 6, 8, 10, 100]


def test_farthest_points(spark):
    rng = np.random.default_rng(4)
    rows = cloud(rng, 90, 9) + [(7, 900 + i, 1.0, 1.0, 1.0, 0.0) for i in range(3)]
    got = sorted((r.u is None, r.u or 0, r.seq, r.pid) for r in select.farthest(spark.createDataFrame(rows, POINT), ["u"], "pid", 6).collect())
    want = []
    for u in {r[0] for r in rows}:
        left = sorted((r for r in rows if r[0] == u), key=lambda r: r[1])
        chosen = [left.pop(0)]
        while left and len(chosen) < 6:
            d = [min(sum((r[k] - c[k]) ** 2 for k in (2, 3, 4)) for c in chosen) for r in left]
            chosen.append(left.pop(d.index(max(d))))
        want += [(u is None, u or 0, i, r[1]) for i, r in enumerate(chosen, 1)]
    assert got == sorted(want)


def test_touching_cells_and_components(spark):
    rng = np.random.default_rng(5)
    cells = {(int(u), *map(int, c)) for u, c in zip(rng.integers(0, 2, 120), rng.integers(-4, 5, (120, 3)), strict=True)}
    got = {(r.u, r.i, r.j, r.k): tuple(r.root) for r in select.touching_cells(spark.createDataFrame(sorted(cells), "u long, i long, j long, k long"), "u", ["i", "j", "k"]).collect()}
    assert set(got) == cells
    want, left = {}, set(cells)
    for c in sorted(cells):
        todo = [c] if c in left else []
        while todo:
            d = todo.pop()
            if d in left:
                left.remove(d)
                want[d] = c
                todo += [(d[0], d[1] + x, d[2] + y, d[3] + z) for x, y, z in itertools.product((-1, 0, 1), repeat=3)]
    assert got == {c: r for c, r in want.items() if c in cells}
    none = spark.createDataFrame([], "u long, v long")
    assert components.connected_components(none).count() == 0


def test_twenty_million_edges_have_a_mark(spark):
    edges = spark.range(20_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    n, total, mixed = components.edges_mark(edges)
    assert n == 20_000_000 and total is not None and mixed != 0


def plain_density(pixels, radius, least):
    pixels = sorted(set(pixels))
    near = {p: [q for q in pixels if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= radius**2] for p in pixels}
    cores = {p for p in pixels if len(near[p]) >= least}
    label = {}
    for c in sorted(cores):
        todo = [c] if c not in label else []
        while todo:
            p = todo.pop()
            if p not in label:
                label[p] = c
                todo += [q for q in near[p] if q in cores]
    for p in pixels:
        if p not in cores and any(q in cores for q in near[p]):
            label[p] = min(label[q] for q in near[p] if q in cores)
    return label


@pytest.mark.parametrize(("radius", "least"), [(1.5, 3), (6.0, 4), (3.0, 1)])
def test_density_clusters(spark, radius, least):
    rng = np.random.default_rng(6)
    rows = [(int(u), int(x), int(y)) for u, x, y in zip(rng.integers(0, 2, 160), rng.integers(-20, 30, 160), rng.integers(0, 30, 160), strict=True)]
    got = {(r.u, r.px, r.py): tuple(r.cluster) for r in select.density_clusters(spark.createDataFrame(rows, "u long, px long, py long"), "u", radius, least).collect()}
    assert got == {(u, *p): c for u in (0, 1) for p, c in plain_density([r[1:] for r in rows if r[0] == u], radius, least).items()}


def test_running_sums_and_items_at_places(spark):
    rng = np.random.default_rng(7)
    rows = [(None if k == 2 else int(k), i, int(w) if w < 8 else None) for i, (k, w) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 9, 200), strict=True))]
    df = spark.createDataFrame(rows, "k long, item long, w long").repartition(5)
    got = {r.item: r.before for r in ranges.running_sums(df, ["k"], "item", "w").collect()}
    assert got == {i: sum(w or 0 for k2, j, w in rows if k2 == k and j < i) for k, i, _ in rows}
    draws = [(k, int(p)) for k in (None, 0, 1, 9) for p in rng.integers(0, 320, 60)]
    want = []
    for k, p in draws:
        at = 0
        for k2, i, w in rows:
            if k2 == k and w:
                if at <= p < at + w:
                    want.append((str(k), p, i))
                at += w
    found = ranges.items_at(spark.createDataFrame(draws, "k long, place long"), df, ["k"], "item", "w")
    assert sorted((str(r.k), r.place, r.item) for r in found.collect()) == sorted(want)


def test_nearest_key(spark):
    rng = np.random.default_rng(8)
    layers = [(int(k), float(a), int(i)) for i, (k, a) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 100, 60), strict=True))] + [(None, 5.0, 99), (0, None, 98), (1, 3.0, None)]
    rows = [(int(k), float(a) / 2, i) for i, (k, a) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(-10, 220, 300), strict=True))] + [(None, 4.0, 300), (0, None, 301), (3, 1.0, 302)]
    got = {r.id: (r.layer, r.gap) for r in ranges.nearest_key(spark.createDataFrame(rows, "k long, at double, id long").repartition(4), spark.createDataFrame(layers, "k long, at double, layer long"), ["k"], "at", "layer").collect()}
    assert len(got) == len(rows)
    for k, a, i in rows:
        best = min(((abs(a - b), n) for k2, b, n in layers if k2 == k and None not in (a, b, n)), default=(None, None))
        assert got[i] == (best[1], best[0])


@pytest.mark.parametrize("kind", ["even", "crowded", "flat", "one place"])
def test_nearest_of_any_density(spark, kind):
    rng = np.random.default_rng(9)
    q, t = rng.random((80, 3)), rng.random((200, 3))
    if kind == "crowded":
        t[:150] = 0.5 + t[:150] * 1e-5
        q[:40] = 0.5 + q[:40] * 1e-5
    elif kind == "flat":
        q[:, 2] = t[:, 2] = 3.0
    elif kind == "line":
        t[:, 1:] = 0.0
    elif kind == "one place":
        t[:] = 0.25
    rows = lambda p, a: [(i % 2, a + i, *map(float, x)) for i, x in enumerate(p)]
    shape = "u long, pid long, x double, y double, z double"
    # some targets have the ids of queries and count for the others only
    got = {r.pid: r.dist for r in spatial.nearest(spark.createDataFrame(rows(q, 0), shape), spark.createDataFrame(rows(t, 60), shape), "u").collect()}
    for i, x in enumerate(q):
        want = min(((x - y) ** 2).sum() ** 0.5 for j, y in enumerate(t) if j % 2 == i % 2 and 60 + j != i)
        assert abs(got[i] - want) < 1e-12


def test_the_first_round_meets_few_targets(spark):
    rng = np.random.default_rng(10)
    p = rng.random((3000, 3))
    df = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "u long, pid long, x double, y double, z double")
    q = df.select("u", F.col("pid").alias("q"), *[F.col(k).alias(f"q{k}") for k in "xyz"])
    for queries in (q, q.withColumns({f"q{k}": F.col(f"q{k}") / 100 for k in "xyz"})):
        targets = df if queries is q else df.withColumns({k: F.col(k) / 100 for k in "xyz"}).unionByName(df.limit(1))
        met = spatial.points_in_reach(queries.join(spatial.cell_widths(queries, targets), "u"), targets)
        assert met.count() < 100 * 3000


def test_sample_rows_takes_the_first_hashes(spark):
    df = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    want = [r.a for r in df.orderBy(select.hash_order("a", seed=3)).limit(700).collect()]
    one = lambda n: spark.createDataFrame([(n,)], "n long")
    assert sorted(r.a for r in select.sample_rows(df, ["a"], one(700), 3).collect()) == sorted(want)
    assert select.sample_rows(df, ["a"], one(9000), 3).count() == 5000 and select.sample_rows(df, ["a"], one(0), 3).count() == 0
    assert select.sample_rows(df.limit(0), ["a"], one(5), 3).count() == 0 and select.sample_rows(df, ["b"], one(10), 3).count() == 10


def test_signed_ranks_of_many_equal_differences(spark):
    d = spark.range(2_200_000).select(F.lit("a").alias("k"), F.when(F.col("id") % 4 == 0, -1.0).otherwise(1.0).alias("d"))
    r = robust.signed_rank(d, ["k"]).first()
    n = 2_200_000
    assert r.n == n and r.tie_term == float(n**3 - n) and r.w_plus + r.w_minus == n * (n + 1) / 2 and r.z > 0


def test_running_stream_goes_on_from_its_state(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.range(90).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"), F.struct(F.col("id").alias("at"), (F.col("id") % 9).alias("done"), F.lit(9).cast("long").alias("total")).alias("step"))
    for part in (df.where("step.at < 40"), df.where("step.at >= 40")):
        part.repartition(3).write.mode("append").parquet(source)
        shards.running(shards.read_shards(spark, source, df.schema, files_per_batch=2), ["k"], "v", "step", out, state).awaitTermination()
    now = shards.latest(spark.read.parquet(out), ["k"])
    got = {r.k: (r.n, r.total, r["mean"], r["last"].at) for r in now.collect()}
    assert got == {r.k: (r.n, r.t, r.m, r.l) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("t"), F.avg("v").alias("m"), F.max("step.at").alias("l")).collect()}
    done = sum(i % 9 for i in (86, 87, 88, 89))
    assert tuple(shards.progress(now).first()) == (4, done, 36, round(100 * done / 36, 4))


def test_resume_drops_done_keys_in_the_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.range(60).select((F.col("id") % 10).alias("k"), F.col("id").alias("n"))
    for part in (df.where("n < 5"), df.where("n >= 5")):
        part.repartition(3).write.mode("append").parquet(source)
        shards.resume(shards.read_shards(spark, source, df.schema, files_per_batch=1), ["k"], out, state).awaitTermination()
    done = spark.read.parquet(out)
    assert sorted(r.k for r in done.collect()) == list(range(10)) and {r.n for r in done.where("k < 5").collect()} == set(range(5))


def test_few_within_radius_matches_the_other_way(spark):
    rng = np.random.default_rng(11)
    a = spark.createDataFrame(cloud(rng, 40, 9), POINT).withColumn("r", F.lit(2.0) + F.coalesce("u", F.lit(0)))
    b = spark.createDataFrame(cloud(rng, 200, 9), POINT).withColumn("r", F.lit(2.0) + F.coalesce("u", F.lit(0)))
    for radius in (3.0, "r"):
        want = sorted(r.pid for r in spatial.within_radius(a, b, ["u"], radius).collect())
        assert sorted(r.pid for r in spatial.few_within_radius(a, b, ["u"], radius, ["u", "pid"]).collect()) == want and want


def block(cubes):
    """The closed surface of unit cubes as triangles (a, b, c, corners), outward."""
    cubes, corners, out = set(cubes), {}, []
    for c in sorted(cubes):
        for axis, side in itertools.product(range(3), (0, 1)):
            if tuple(c[i] + (2 * side - 1) * (i == axis) for i in range(3)) in cubes:
                continue
            u, v = [i for i in range(3) if i != axis]
            quad = [tuple(c[i] + (side if i == axis else du if i == u else dv) for i in range(3)) for du, dv in ((0, 0), (1, 0), (1, 1), (0, 1))]
            if (side == 1) == (axis == 1):
                quad.reverse()
            out += [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
    return [(*[corners.setdefault(p, len(corners)) for p in f], *[list(map(float, p)) for p in f]) for f in out]


def valley(n, slope):
    """Strips along x that bend upwards by a few degrees from one to the next."""
    height = [slope * (i * i) for i in range(n + 1)]
    at = lambda i, j: [float(i), 4.0 * j, height[i]]
    out = []
    for i in range(n):
        a, b, c, d = (i, 0), (i + 1, 0), (i + 1, 1), (i, 1)
        out += [(a, b, c), (a, c, d)]
    return [(*[2 * i + j for i, j in f], *[at(i, j) for i, j in f]) for f in out]


def plain_screen(faces, sharp, smooth):
    import hashlib
    import math

    p = [np.array(f[3:6]) for f in faces]
    cross = [np.cross(x[1] - x[0], x[2] - x[0]) for x in p]
    normal, middle = [c / np.linalg.norm(c) for c in cross], [x.sum(0) / 3 for x in p]
    flat = np.concatenate(p)
    spacing = float(np.linalg.norm(flat.max(0) - flat.min(0))) / (66.667 * 2)
    sides = {}
    for i, f in enumerate(faces):
        for k in range(3):
            sides.setdefault(tuple(sorted((f[k], f[(k + 1) % 3]))), []).append(i)
    place = {f[k]: p[i][k] for i, f in enumerate(faces) for k in range(3)}
    along, concave = [], set()
    for (u, v), two in sides.items():
        if len(two) != 2:
            continue
        i, j = sorted(two)
        cosine = normal[i] @ normal[j]
        if (middle[j] - middle[i]) @ normal[i] <= 0 or cosine >= math.cos(math.radians(smooth)):
            continue
        if cosine < math.cos(math.radians(sharp)):
            n = max(2, math.ceil(float(np.linalg.norm(place[v] - place[u])) / spacing))
            along += [((i, j, k), place[u] + (place[v] - place[u]) * k / (n - 1)) for k in range(n)]
        else:
            concave |= {i, j}
    units = {i: math.floor(float(np.linalg.norm(cross[i])) / 2 * 1000000) for i in sorted(concave)}
    total, on = sum(units.values()), []
    for k in range(math.ceil(total / (1000000 * spacing * spacing)) if total else 0):
        chance = [int(hashlib.md5(f"0|{k}|{s}".encode()).hexdigest()[:7], 16) / (1 << 28) for s in range(3)]
        at = math.floor(chance[0] * total)
        for i, w in units.items():
            if at < w:
                break
            at -= w
        r, t = math.sqrt(chance[1]), chance[2]
        on.append(((k,), (1 - r) * p[i][0] + r * (1 - t) * p[i][1] + r * t * p[i][2]))
    kept = set()
    for points in (along, on):
        chosen = []
        for _, x in sorted(points, key=lambda y: y[0]):
            if all(((x - y) ** 2).sum() > (0.75 * spacing) ** 2 for y in chosen):
                chosen.append(x)
        kept |= {tuple(np.round(x, 4) + 0.0) for x in chosen}
    closed = all(len(x) == 2 for x in sides.values())
    return len(kept), abs(sum(x[0] @ np.cross(x[1], x[2]) for x in p) / 6) if closed else -1.0


@pytest.mark.parametrize(("faces", "least"), [(block([(0, 0, 0), (1, 0, 0), (0, 1, 0)]), 20), (valley(4, 0.02), 20)])
def test_screen_of_parts(spark, faces, least):
    from trialforge.plans.meshes import screen_parts

    shape = "object long, face long, a long, b long, c long, pa array<double>, pb array<double>, pc array<double>"
    df = spark.createDataFrame([(0, i, *f) for i, f in enumerate(faces)], shape)
    r = screen_parts(df, 8.0, 1.0, 30).first()
    n, volume = plain_screen(faces, 8.0, 1.0)
    assert (r.anchors, round(r.volume, 9), r.dense) == (n, round(volume, 9), n > 30) and n >= least
