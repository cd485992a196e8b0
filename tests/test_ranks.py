"""Quantiles and selections from ranks, against numpy and plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.operators import robust as R
from trialforge.operators import select as K
from trialforge.operators import spatial as S


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    # one group holds most rows, values tie often
    return [("big" if i % 10 else "small", i, float(v)) for i, v in enumerate(rng.integers(0, 40, 600))] + [("one", 1000, 3.5), ("none", 1001, None)]


def test_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, pid long, v double")
    got = {r.k: r for r in R.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.99}, {"t": 0.05}).collect()}
    assert set(got) == {"big", "small", "one"}
    for k, r in got.items():
        v = np.sort([x for g, _, x in rows if g == k])
        cut = int(0.05 * len(v))
        assert np.allclose([r.a, r.b, r.c, r.t], [*np.quantile(v, [0.5, 0.9, 0.99]), v[cut : len(v) - cut].mean()])
    assert [tuple(r) for r in R.quantiles(df.where("v is null"), [], "v", {"a": 0.5}).collect()] == [(None,)]


def test_top_n_matches_sorting(spark, rows):
    df = spark.createDataFrame(rows, "k string, pid long, v double")
    n = {"big": 101, "small": 7, "one": 5}
    got = {(r.k, r.pid) for r in R.top_n(df, ["k"], "v", "pid", spark.createDataFrame(list(n.items()), "k string, n long")).collect()}
    want = {(k, p) for k, m in n.items() for _, p in sorted((-v, p) for g, p, v in rows if g == k)[:m]}
    assert got == want


def test_min_max_of_flat_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "u string, v double")
    assert sorted(tuple(r) for r in S.min_max(df, ["u"], "v", "s").collect()) == [("a", 1.0, 0.0), ("a", 3.0, 1.0), ("b", 2.0, 0.0), ("b", 2.0, 0.0)]


def test_groups_without_a_name_are_ranked(spark):
    rows = [(None, float(i % 7), 2.0 * i) for i in range(30)] + [("a", float(i), None) for i in range(5)]
    got = {r.k: r for r in R.summary(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], {"n": F.count(F.lit(1))}, {"m": ("v", 0.5), "q": ("w", 0.9)}, {"t": ("v", 0.1)}).collect()}
    v = np.sort([i % 7 for i in range(30)])
    assert got[None].n == 30 and got[None].m == np.median(v) and np.isclose(got[None].q, np.quantile(2.0 * np.arange(30), 0.9)) and np.isclose(got[None].t, v[3:27].mean())
    assert got["a"].m == 2.0 and got["a"].q is None


def test_few_rows_have_plain_means(spark):
    rows = [("few", float(x)) for x in (0, 0, 0, 100)] + [("many", float(x)) for x in range(20)]
    got = {r.k: r.t for r in R.summary(spark.createDataFrame(rows, "k string, v double"), ["k"], {}, {}, {"t": ("v", 0.25)}, whole=10).collect()}
    assert got == {"few": 25.0, "many": np.arange(5, 15).mean()}


def test_range_ranks_are_places(spark):
    rows = [(f"k{i % 3}", f"{i * 7919 % 500:05}") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(7)
    got = {(r.k, r.v): r["rank"] for r in R.range_ranks(df, ["k"], "v").collect()}
    for k in ("k0", "k1", "k2"):
        assert [got[k, v] for v in sorted(v for g, v in rows if g == k)] == list(range(sum(g == k for g, _ in rows)))


def test_rounds_match_a_walk_in_order(spark):
    rng = np.random.default_rng(4)
    points = lambda n: [(int(o), i, *map(float, rng.integers(0, 12, 3))) for i, o in enumerate(rng.integers(0, 3, n))]
    a, b = points(150), points(130)
    schema = "object long, pid long, x double, y double, z double"
    pairs = S.pairs_within(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["object"], 3.0)
    all_pairs = sorted((float(np.sqrt(sum((p - q) ** 2 for p, q in zip(x[2:], y[2:], strict=True)))), x[1], y[1], x[0]) for x in a for y in b if x[0] == y[0])
    near = [p for p in all_pairs if p[0] <= 3.0]
    assert sorted((r.object, r.a, r.b) for r in pairs.collect()) == sorted((o, i, j) for _, i, j, o in near)
    used_a, used_b, want = set(), set(), set()
    for _, i, j, o in near:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.add((o, i, j))
    assert {(r.object, r.a, r.b) for r in K.closest_first(pairs, "object").collect()} == want
    assert K.closest_first(pairs.limit(0), "object").count() == 0


#: Counts of a published table (matched and all predicted points, matched and all hot points) and its scores.
PUBLISHED = [
    (56355.0, 104980.0, 503814.0, 1423823.0, 0.4265372343410431),
    (56165.0, 102860.0, 538831.0, 1423823.0, 0.44704532578244344),
    (52599.0, 90312.0, 502691.0, 1423823.0, 0.4396191041032453),
    (54135.0, 91513.0, 617646.0, 1423823.0, 0.5005380499320108),
    (41819.0, 73176.0, 473983.0, 1408297.0, 0.4236369136936217),
    (82730.0, 156093.0, 658907.0, 1423823.0, 0.494112355522886),
    (79871.0, 137572.0, 723643.0, 1423823.0, 0.5420048372392612),
    (74116.0, 123427.0, 709290.0, 1423823.0, 0.5445564490878572),
]


def test_micro_scores_of_published_counts(spark):
    df = spark.createDataFrame(PUBLISHED, "a double, n_a double, b double, n_b double, want double")
    rows = df.select(S.prf(F.col("a"), F.col("n_a"), F.col("b"), F.col("n_b"))[2].alias("f1"), "want").collect()
    assert len(rows) == 8 and all(abs(r.f1 - r.want) < 1e-12 for r in rows)
