"""Density clusters in tiles against brute force."""

import numpy as np
import pytest

from roadloom.operators import clustering, density, spatial
from roadloom.operators import lines as ln


def brute(rows, eps, least, turn):
    ids = np.array([r[0] for r in rows])
    xy, h = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    near = d <= eps if turn is None else (d <= eps) & (ln.angle(h[:, None], h) <= turn)
    core = near.sum(axis=1) >= least
    label, changed = np.where(core, ids, -1), True
    while changed:
        low = np.array([label[near[k] & core].min() if core[k] else -1 for k in range(len(ids))])
        changed, label = (low != label).any(), low
    for k in np.flatnonzero(~core):
        c = np.flatnonzero(near[k] & core)
        if len(c):
            label[k] = label[c[np.lexsort((ids[c], d[k, c]))[0]]]
    return {(int(i), int(c)) for i, c in zip(ids, label, strict=True) if c >= 0}


@pytest.mark.parametrize(("eps", "least", "turn"), [(3.0, 4, None), (6.0, 4, 30.0), (4.0, 2, 170.0)])
def test_tiles_equal_brute_force(spark, monkeypatch, eps, least, turn):
    """Clusters that run through many tiles, with crowds, thin stretches and points on borders, and without the cells of pairs."""
    r = np.random.default_rng(int(eps))
    xy = np.concatenate((np.stack([r.uniform(-90, 90, 250), r.normal(0, 1, 250)], axis=1), r.uniform(-90, 90, (250, 2)), np.round(r.normal(0, 4, (150, 2)))))
    rows = [(int(k), *p, float(h)) for k, p, h in zip(r.permutation(len(xy)), xy.tolist(), r.choice([88.0, 95.0, 271.0], len(xy)) + r.normal(0, 12, len(xy)), strict=True)]
    want = brute(rows, eps, least, turn)

    def listed(*_, **__):
        raise AssertionError("cells of near points are listed")

    monkeypatch.setattr(spatial, "_near_cells", listed)
    monkeypatch.setattr(density, "TILE", 4)
    d = spark.createDataFrame([*rows, (9000, float("nan"), 1.0, 0.0), (9001, None, 1.0, 0.0)], "id long, x double, y double, heading double")
    got = clustering.density_clusters(d, eps, least, turn, keep=("x",)).collect()
    assert {(q.id, q.cluster) for q in got} == want and len(got) == len(want) and len({c for _, c in want}) > 3
    assert {(q.id, q.x) for q in got} <= {q[:2] for q in rows}
