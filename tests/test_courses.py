"""Groups of windows against brute force over all pairs, and without pairs."""

import itertools

import numpy as np
import pytest

from roadloom.operators import clustering, courses, kernels, spatial
from roadloom.operators import lines as ln


def brute(rows, centre, degrees, most):
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    linked = set()
    for p, q in itertools.combinations(rows, 2):
        if np.hypot(p[2] - q[2], p[3] - q[3]) <= centre and ln.angle(p[4], q[4]) <= degrees and kernels.frechet(np.array(p[1]), np.array(q[1])) <= most:
            linked |= {p[0], q[0]}
            a, b = find(p[0]), find(q[0])
            root[max(a, b)] = min(a, b)
    return {(k, find(k)) for k in linked}


def windows(n, seed, side):
    """Short lines of 2 to 9 points around a square, in all directions, some of them turning."""
    r = np.random.default_rng(seed)
    out = []
    for k in r.permutation(n).tolist():
        h, bend = r.uniform(0, 2 * np.pi), r.normal(0, 0.25)
        turn = h + bend * np.arange(r.integers(1, 9))
        xy = np.cumsum(np.concatenate((r.uniform(-side, side, (1, 2)), 5 * np.stack((np.sin(turn), np.cos(turn)), axis=1) + r.normal(0, 1, (len(turn), 2)))), axis=0)
        out.append((k, xy.tolist(), *xy.mean(axis=0).tolist(), float(ln.bearings(xy[-1] - xy[0]))))
    return out


KIND = f"sid long, line {ln.LINE}, x double, y double, heading double"


@pytest.mark.parametrize(("side", "centre", "degrees", "most"), [(60, 35.0, 30.0, 16.0), (40, 6.0, 60.0, 9.0), (150, 12.0, 120.0, 20.0)])
def test_groups_equal_brute_force(spark, monkeypatch, side, centre, degrees, most):
    def listed(*_):
        raise AssertionError("pairs of windows are listed")

    monkeypatch.setattr(spatial, "pairs", listed)
    rows = windows(400, side, side)
    want = brute(rows, centre, degrees, most)
    d = spark.createDataFrame([*rows, (900, [(0.0, 0.0), (float("nan"), 1.0)], float("nan"), 0.5, 0.0)], KIND)
    got = {(r.sid, r.component) for r in clustering.subtrajectory_groups(d, centre, degrees, most, members=1, support=0.0).collect()}
    assert got == want and len({c for _, c in want}) > 5


def test_dense_windows_need_few_comparisons(monkeypatch):
    """Along one road the number of lines compared grows with the lines, not with their square."""
    seen, real = [], courses.Courses.alike
    monkeypatch.setattr(courses.Courses, "alike", lambda w, i, j: (seen.append(len(i)), real(w, i, j))[1])
    r = np.random.default_rng(3)
    at = np.sort(r.uniform(0, 300, 3000))
    xy = [np.stack([s + 5 * np.arange(13), r.uniform(-3, 3, 13)], axis=1) for s in at]
    middle = np.array([p.mean(axis=0) for p in xy])
    order = np.argsort(middle[:, 0])
    w = courses.Courses([xy[k] for k in order], middle[order], np.full(3000, 90.0), 35.0, 30.0, 16.0)
    assert len(set(courses._components(w).tolist())) == 1
    assert sum(seen) < 30 * 3000


def test_groups_that_no_leader_joins():
    """Two leaders whose stars touch by a pair of which neither is a leader."""
    lines = [np.array([(x, 0.0), (x + 10, 0.0)]) for x in (0.0, 9.0, 18.0, 27.0)]
    w = courses.Courses(lines, np.array([p.mean(axis=0) for p in lines]), np.full(4, 90.0), 35.0, 30.0, 10.0)
    label = np.array([0, 0, 1, 1])
    courses._join_open(w, label)
    assert label.tolist() == [0, 0, 0, 0]
    w.most = 8.0
    label = np.array([0, 0, 1, 1])
    courses._join_open(w, label)
    assert label.tolist() == [0, 0, 1, 1]


def test_long_traces_keep_all_windows(spark):
    xy = [(5.0 * k, 0.0) for k in range(1500)]
    d = spark.createDataFrame([(1, xy)], f"id long, line {ln.LINE}")
    w = clustering.subtrajectories(d).collect()
    assert sorted(r.win for r in w) == list(range(373)) and len({r.sid for r in w}) == 373
    assert max(p.x for r in w for p in r.line) == pytest.approx(7495.0)


def test_the_network_reaches_the_end_of_long_traces(spark):
    d = spark.createDataFrame([(k, [(5.0 * i, 0.5 * k) for i in range(1500)]) for k in range(3)], f"id long, line {ln.LINE}")
    nodes, edges = clustering.network_of(d, members=2, support=2.0)
    assert nodes.count() > 0
    groups = clustering.subtrajectory_groups(clustering.subtrajectories(d), members=2, support=2.0)
    assert groups.count() == 3 * 373


def test_equal_vertices_all_count(spark):
    line = [(0.0, 0.0), (50.0, 0.0), (100.0, 0.0)]
    reps = spark.createDataFrame([(1, line, 2.0), (2, line, 2.0)], f"id long, line {ln.LINE}, support double")
    got = sorted((r.x, r.weight, r.members) for r in clustering.vertices(reps).collect())
    assert got == [(0.0, 4.0, 2), (100.0, 4.0, 2)]
