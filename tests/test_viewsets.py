"""Suppression of similar views against plain loops over all views of objects with more than 110."""

import numpy as np
import pytest

from trialforge.operators import select
from trialforge.plans import viewsets as V

NAMES = ["angle_nms", "last_kept_nms", "cosine_nms", "diverse_views"]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    d = str(tmp_path_factory.mktemp("views"))
    vectors = [[float(np.float32(x)) for x in v] for v in rng.standard_normal((1400, 16))]
    # the first 300 views of object 1 lie at few places and along one direction: what differs from them comes late
    rows = [(12 * 11 * i + int(rng.integers(0, 3)), 1, [5 + v[0] / 9, *v[1:]]) for i, v in enumerate(vectors[:300])]
    rows += [(10**6 + i, 1 + i % 2, [v[0] - 9, *v[1:]]) for i, v in enumerate(vectors[300:])]
    rows = [(i, o, [v[0], 9 - n / 100, *v[2:]]) for n, (i, o, v) in enumerate(rows)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


def similar_suppressed(vectors, similar, last_only=False):
    """Rows kept in input order: each that isn't similar to any kept before (last_only: to the last kept one)."""
    kept = []
    for i in range(len(vectors)):
        against = vectors[kept[-1:] if last_only else kept]
        if not len(against) or not similar(against, vectors[i]).any():
            kept.append(i)
    return kept


def plain(spark, d, name):
    rows = sorted(V.views(spark, d).collect(), key=lambda r: (r.object, -r.score, r.view))
    a, e = (np.radians([r[c] for r in rows]) for c in ("az", "el"))
    unit = np.stack([np.cos(e) * np.cos(a), np.cos(e) * np.sin(a), np.sin(e)], axis=1)
    a, e = a / 2, e / 2
    rotation = np.stack([np.cos(a) * np.cos(e), -np.sin(a) * np.sin(e), np.cos(a) * np.sin(e), np.sin(a) * np.cos(e)], axis=1)
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    x, similar = {
        "angle_nms": (unit, lambda a, x: a @ x > np.cos(np.radians(30.0))),
        "last_kept_nms": (unit, lambda a, x: a @ x > 1e-9),
        "cosine_nms": (m, lambda a, x: a @ x >= 0.3),
        "diverse_views": (rotation, lambda a, x: 2 * np.arccos(np.clip(np.abs(a @ x), 0, 1)) < 1.5),
    }[name]
    out = []
    for o in sorted({r.object for r in rows}):
        at = np.array([i for i, r in enumerate(rows) if r.object == o])
        out += [(o, n, rows[at[k]].view) for n, k in enumerate(similar_suppressed(x[at], similar, name == "last_kept_nms"), 1)]
    return out


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("block", [4096, 300])
def test_all_views_are_met(name, block, spark, many, monkeypatch):
    monkeypatch.setattr(select, "BLOCK", block)
    got = [(r.object, r.seq, r.view) for r in getattr(V, name)(spark, many).collect()]
    assert sorted(got) == sorted(plain(spark, many, name))
