import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.operators import cohort, robust, spatial
from trialforge.sources import files
from trialforge.streaming import shards


def plain_p(d, side):
    """Exact by all signs of the ranks of |d| (distinct, not zero)."""
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = ranks[np.array(d) > 0].sum()
    all_w = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    less, greater = np.mean([x <= w for x in all_w]), np.mean([x >= w for x in all_w])
    return {"less": less, "greater": greater, "two-sided": min(1.0, 2 * min(less, greater))}[side]


@pytest.mark.parametrize("side", ["less", "greater", "two-sided"])
def test_exact_signed_rank_p(side):
    for d in ([1.0, -2.0, 3.0, 4.5, -5.1], [0.1, 0.2, 0.3], [-1.0, 2.0, -3.0, 4.0, -5.0, 6.0, -7.0]):
        ranks = np.argsort(np.argsort(np.abs(d))) + 1
        assert abs(robust.signed_rank_p(len(d), float(ranks[np.array(d) > 0].sum()), 0, side) - plain_p(d, side)) < 1e-12
    assert robust.signed_rank_p(0, 0.0, 0, side) is None


def test_ranks_and_trimmed_means(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), None if rng.random() < 0.05 else float(v)) for k, v in zip(rng.integers(0, 3, 900), np.round(rng.normal(size=900), 1), strict=True)]
    df = spark.createDataFrame(rows, "k int, v double")
    for bands in (2, 7, 64):
        got = {(r.k, r.v): (r.same, r.below, r.total) for r in robust.value_ranks(df, ["k"], "v", bands).collect()}
        for k in range(3):
            vs = [v for i, v in rows if i == k and v is not None]
            assert {v: x for (i, v), x in got.items() if i == k} == {v: (vs.count(v), sum(x < v for x in vs), len(vs)) for v in set(vs)}
    tm = {r.k: r.trimmed for r in robust.trimmed_mean(df, ["k"], "v").collect()}
    for k in range(3):
        vs = sorted(v for i, v in rows if i == k and v is not None)
        cut = int(0.05 * len(vs))
        assert abs(tm[k] - np.mean(vs[cut : len(vs) - cut])) < 1e-9
    sr = robust.signed_rank(df.withColumnRenamed("v", "d"), ["k"]).collect()
    for r in sr:
        assert r.w_plus + r.w_minus == r.n * (r.n + 1) / 2


def test_first_by_ignores_the_order_of_rows(spark):
    rows = [("a", 2, 1, 5.0), ("a", 1, 9, 6.0), ("a", 1, 3, None), ("b", 0, 0, 1.0)]
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(list(order), "k string, rank int, seq int, v double")
        assert sorted(map(tuple, cohort.first_by(df, ["k"], ["rank", "seq"]).collect())) == [("a", 1, 3, None), ("b", 0, 0, 1.0)]


def points(spark, n, seed, size=30.0):
    rng = np.random.default_rng(seed)
    xyz = np.round(rng.random((n, 3)) * size - size / 2, 2)
    return xyz, spark.createDataFrame([(i % 2, i, *map(float, p), 2.0 + i % 2) for i, p in enumerate(xyz)], "u long, pid long, x double, y double, z double, r double")


def test_radius_and_nearest_match_brute_force(spark):
    a, da = points(spark, 150, 1)
    b, db = points(spark, 60, 2)
    dist = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    same = (np.arange(150)[:, None] % 2) == (np.arange(60)[None] % 2)
    near = (dist <= (2.0 + np.arange(150) % 2)[:, None]) & same
    hit = {r.pid for r in spatial.within_radius(da, db, ["u"], "r").collect()}
    assert hit == set(np.flatnonzero(near.any(1)).tolist())
    assert {r.pid for r in spatial.within_radius(da, db, ["u"], "r", anti=True).collect()} == set(range(150)) - hit
    other = np.where(same & (np.arange(150)[:, None] != np.arange(60)[None]), dist, np.inf).min(1)
    got = {r.pid: r.dist for r in spatial.nearest(da, db, "u").collect()}
    assert all(abs(got[i] - other[i]) < 1e-9 for i in range(150))
    assert spatial.nearest(da, db.limit(0), "u").where("dist is null").count() == 150


def test_sources(spark, tmp_path):
    d = tmp_path / "trials" / "hs1.25"
    d.mkdir(parents=True)
    names = [f.name for f in files.TRIAL_SCHEMA]
    line = lambda **v: ",".join(str(v.get(n, "")) for n in names)
    (d / "a.csv").write_text("\n".join([",".join(names), line(object="007", load_case="bending", n_cells=5, energy_total="NaN", status="ok"), "broken,line"]) + "\n")
    (d / "b.csv").write_text("\ufeffstatus, extra,vm_p99_crit,candidate,load_case,object,status\nok,\"a, b\",2.5,c,torsion,008,bad\nok,,NaN,c,torsion,009,\n")
    (tmp_path / "trials" / "c.csv").write_text("object,load_case,candidate\n1,bending,c\n")
    (tmp_path / "trials" / "empty.csv").write_text("")
    (d / "x_aggregated.csv").write_text(",".join(names) + "\n" + line(object="9", status="ok") + "\n")
    rows = files.read_trials(spark, str(tmp_path / "trials")).where("status is not null").collect()
    assert sorted((r.object, r.load_case, r.n_cells, r.vm_p99_crit, r.energy_total, r.status, r.h_scale) for r in rows) == [
        ("007", "bending", 5, None, None, "ok", 1.25), ("008", "torsion", None, 2.5, None, "ok", 1.25), ("009", "torsion", None, None, None, "ok", 1.25)
    ]
    assert sorted((r.files, r.missing) for r in files.file_layouts(spark, str(tmp_path / "trials")).collect()) == [(1, []), (1, []), (1, ["status"])]
    assert files.read_trials(spark, str(tmp_path / "trials" / "c.csv")).count() == 0
    p = spark.createDataFrame([("a", 1.0, 2.0, -3.5e-7, 4.0), ("a", 0.0, 0.0, 0.0, 8.0), ("b", 1.0, 1.0, 1.0, 2.0)], "u string, x double, y double, z double, val double")
    files.write_points_text(p, str(tmp_path / "pos"), ["u"])
    back = files.read_points_text(spark, str(tmp_path / "pos")).collect()
    assert sorted((r.x, r.y, r.z, r.val) for r in back) == [(0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0, 0.0), (1.0, 2.0, -3.5e-7, 0.0)]
    np.save(tmp_path / "pts.npy", np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "flat.npy", np.arange(6.0))
    assert [(r.seq, r.x, r.z) for r in files.read_point_arrays(spark, str(tmp_path)).orderBy("seq").collect()] == [(0, 0.0, 2.0), (1, 3.0, 5.0)]
    (tmp_path / "sizes.json").write_text(json.dumps({"a": {"h_fine": 0.5, "h_max": 2.0}, "b": {"h_fine": 1.0}}))
    assert sorted((r.key, r.h_fine, r.h_max) for r in files.read_map_json(spark, str(tmp_path / "sizes.json"), "h_fine double, h_max double").collect()) == [("a", 0.5, 2.0), ("b", 1.0, None)]
    (tmp_path / "ids.txt").write_text("a /x\n\n# no\n b \n")
    assert [tuple(r) for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == [("a", "/x"), ("b", None)]
    files.write_queue(p.limit(1), str(tmp_path / "queue"), ["u", "x"])
    assert [r.value for r in spark.read.text(str(tmp_path / "queue")).collect()] == ["a|1.0"]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    total = lambda: {r.k: (r.n, r.t) for r in spark.read.parquet(out).groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).collect()}
    for part in (df.where("v < 50"), df.where("v >= 50")):
        part.repartition(3).write.mode("append").parquet(source)
        shards.refresh(shards.read_shards(spark, source, df.schema, files_per_batch=2), ["k"], "v", out, state).awaitTermination()
    assert total() == {r.k: (r.n, r.t) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("t")).collect()}
