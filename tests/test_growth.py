"""Steps whose cost must not outgrow their input."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from trialforge.operators import spatial as S


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scattered(spark, n: int, groups: dict[str, int], seed: int, wide: float = 60.0):
    rng = np.random.default_rng(seed)
    rows = [(i, *[int(rng.integers(k)) for k in groups.values()], *[float(v) for v in rng.integers(0, int(wide), 3)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, ["pid", *groups, "x", "y", "z"])


def test_cells_around_rows_are_not_broadcast(spark, tmp_path):
    """27 times a table that looks small would pass the driver's memory."""
    _, a = scattered(spark, 50, {"u": 2}, 1)
    a.write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    for df in (S.within_radius(a, a, ["u"], 5.0), S.few_within_radius(a, a, ["u"], 5.0, ["pid"]), S.pairs_within(a, a, ["u"], 5.0)):
        assert "Broadcast" not in plan_of(df)


def test_cross_hits_are_those_of_all_pairs(spark):
    ra, a = scattered(spark, 300, {"u": 2, "of": 2, "m": 2}, 2)
    rb, b = scattered(spark, 40, {"u": 2, "case": 3}, 3)
    a = a.unionByName(a.limit(20)).unionByName(spark.createDataFrame([(900, 0, 0, 0, float("nan"), 1.0, 1.0)], a.schema))
    ra = [tuple(r) for r in a.collect()]
    near = lambda p, q: sum((s - t) ** 2 for s, t in zip(p[-3:], q[-3:], strict=True)) <= 81.0
    for few in (False, True):
        got = {tuple(r)[:4]: (r.n, r.hits) for r in S.cross_hits(a, b, ["u"], ["of", "m"], ["case"], 9.0, few).collect()}
        want = {}
        for u, of, m, case in itertools.product(range(2), range(2), range(2), range(3)):
            mine, theirs = [p for p in ra if p[1:4] == (u, of, m)], [q for q in rb if q[1:3] == (u, case)]
            if mine and theirs:
                want[u, of, m, case] = len(mine), sum(any(near(p, q) for q in theirs) for p in mine)
        assert got == want


def test_thinning_walks_small_units_and_goes_in_rounds_through_large_ones(spark, monkeypatch):
    from trialforge.operators import select as K

    _, p = scattered(spark, 400, {"u": 3}, 5)
    p = p.unionByName(spark.createDataFrame([(1000 + i, 7, 1.0, 1.0, float(i)) for i in range(4)], p.schema))
    most = spark.createDataFrame([(0, 7), (1, 0)], "u int, n long")
    order = [F.col("z"), -F.col("pid")]
    for limit in (None, most):
        walked, rounds, mixed = (sorted(map(tuple, K.spread(p, ["u"], order, 9.0, limit, walk=w).collect())) for w in (1000, 0, 50))
        assert walked == rounds == mixed and len(walked) > 20
    monkeypatch.setattr(K, "spread_in_rounds", None)  # small units need no round
    assert K.spread(p, ["u"], order, 9.0).count() > 20


def test_points_apart_by_a_plain_walk():
    from trialforge.operators.select import first_apart

    rng = np.random.default_rng(4)
    for radius in (0.0, 1.0, 7.5, -3.0):
        p = np.round(rng.normal(0, 8, (400, 3)), 1)
        p[::7] = p[1]
        want: list[int] = []
        for i in range(len(p)):
            if all(((p[i] - p[j]) ** 2).sum() > radius * radius for j in want):
                want.append(i)
        assert first_apart(*p.T, radius, None) == want and first_apart(*p.T, radius, 5) == want[:5]
    odd = np.array([[0, 0, np.nan], [0, 0, np.nan], [np.inf, 0, 0], [0, 0, 0], [0, 0, 0.5]], float)
    assert first_apart(*odd.T, 1.0, None) == [0, 1, 2, 3] and first_apart(*odd.T, None, None) == [0, 1, 2, 3, 4]


def test_faces_meet_at_their_edge_in_one_shuffle_of_their_corners(spark):
    """What follows from the corners isn't shuffled, and a face is sent once for each edge."""
    from tests.conftest import SF
    from trialforge.plans import meshes as M

    plan = plan_of(M.hinges_of(M.triangles(spark, SF)))
    assert "SortAggregate" not in plan and "Window" in plan
    carried = M.adjacency(M.triangles(spark, SF), ["a", "b", "c", "pa", "pb", "pc"])
    assert [f.name for f in carried.schema["f1"].dataType.fields] == ["face", "a", "b", "c", "pa", "pb", "pc"]


def test_points_that_repeat_meet_no_cell_and_batches_share_a_walk():
    from trialforge.operators.select import Walk

    rng = np.random.default_rng(8)
    p = np.round(rng.uniform(0, 20, (600, 3)), 0)
    p[300:] = p[:300]
    w = Walk(3.0, None)
    parts = [w.meet(*p[a : a + 150].T) for a in range(0, 600, 150)]
    assert [150 * n + i for n, part in enumerate(parts) for i in part] == Walk(3.0, None).meet(*p.T) and parts[2:] == [[], []]
    assert w.kept == sum(map(len, parts)) and len(w.met) <= 300


def test_thinning_shuffles_the_points_own_columns_once(spark, tmp_path):
    from trialforge.operators import select as K

    _, p = scattered(spark, 200, {"u": 3}, 6)
    most = spark.createDataFrame([(0, 7)], "u int, n long")
    plan = plan_of(K.spread(p, ["u"], [F.col("z"), F.col("pid")], 9.0, most))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Join" not in plan and plan.count("Exchange hash") == 1


def test_faces_meet_without_what_hinges_do_not_ask_for(spark):
    from tests.conftest import SF
    from trialforge.plans import meshes as M

    h = M.hinges_of(M.triangles(spark, SF))
    sent = next(line for line in h._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line)
    assert "t1" not in h.columns and "area2" not in sent
    alone = M.hinges_of(M.triangles(spark, SF), alone=True)
    assert alone.where("f2 is not null").count() == h.count() and alone.where("f2 is null").count() > 0
