"""Stretches near other lines, by tiles, against sampled distances and against pair lists."""

import random

import numpy as np
import pytest

from roadloom.operators import coverage, overlay, scores
from roadloom.operators import lines as ln
from roadloom.operators.kernels import point_line_distances


def wiggles(n, seed=2):
    r = random.Random(seed)
    out = [(1000, [(0.0, 0.0), (0.0, 0.0)]), (1001, [(-50.0, 3.0), (210.0, 8.0)])]
    for k in range(n):
        road, steps = r.choice([(1.0, 0.0), (0.0, 1.0), (0.7, 0.7)]), r.randint(2, 14)
        out.append((k, [(12 * i * road[0] + r.uniform(-3, 3), 12 * i * road[1] + r.uniform(-3, 3)) for i in range(steps)]))
    return out


@pytest.mark.parametrize("block", [3, 200_000])
@pytest.mark.parametrize("r", [0.7, 5.0])
def test_length_near_others(spark, monkeypatch, block, r):
    monkeypatch.setattr(coverage, "BLOCK", block)
    rows = wiggles(12)
    d, xy = spark.createDataFrame(rows, f"id long, line {ln.LINE}"), {k: np.array(p) for k, p in rows}
    got = {x.id: (x.total, sum(i.hi - i.lo for i in x.inside)) for x in overlay.covered_intervals(d, d, r, others=True).collect()}
    assert set(got) == {k for k, _ in rows if k != 1000}
    for k, (total, inside) in got.items():
        n = 4000
        p = ln.at_distance(xy[k], (np.arange(n) + 0.5) * ln.length(xy[k]) / n)
        near = np.min([point_line_distances(p, q) for o, q in xy.items() if o != k and ln.length(q) > 0], axis=0) <= r
        assert total == pytest.approx(ln.length(xy[k])) and inside == pytest.approx(near.mean() * total, abs=0.01 * total + 0.1)


def test_redundancy_lists_no_pairs(spark):
    """A road drawn 300 times: of 36 million pairs of its pieces few are looked at."""
    r = random.Random(1)
    rows = [(k, [(12.0 * i + r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(20)]) for k in range(300)]
    d = spark.createDataFrame(rows, f"id long, line {ln.LINE}")
    looked = []
    real = coverage._intervals
    a, b = np.array([[12.0 * i, 0.0, 12.0 * i + 12.0, 0.0, 0.0, 12.0] for i in range(20)] * 300), np.array([[12.0 * i, 1.0, 12.0 * i + 12.0, 1.0] for i in range(20)] * 300)
    try:
        coverage._intervals = lambda p, q, r: (looked.append(len(p)), real(p, q, r))[1]
        row, lo, hi = coverage._covered(a, b, np.zeros(len(a), np.int64), np.full(len(a), len(b)), 5.0, None, None)
    finally:
        coverage._intervals = real
    assert len(row) == len(a) and (lo <= 0).all() and (hi >= 1).all() and sum(looked) < 20 * len(a)
    got = scores.redundancy(d).first()
    assert got.share == pytest.approx(0.5, abs=0.02)


def test_short_lines_are_measured_together(spark):
    rows = [*wiggles(30), (2000, [(5.0, 6.0)]), (2001, [(0.0, 0.0), (0.0, 0.0), (0.0, 3.0), (4.0, 3.0)])]
    got = {r.id: (r.x, r.y, r.heading, r.length) for r in ln.middles(spark.createDataFrame(rows, f"id long, line {ln.LINE}")).collect()}
    for k, p in rows:
        xy = np.array(p)
        want = (*ln.at_distance(xy, np.array([ln.length(xy) / 2]))[0], float(ln.bearings(xy[-1] - xy[0])), ln.length(xy))
        assert got[k] == pytest.approx(want, abs=1e-9)
    xy = np.array(rows[4][1])
    lo = np.linspace(0, ln.length(xy) * 0.8, 9)
    for a, b, part in zip(lo, lo + 7, ln.substrings(xy, lo, lo + 7), strict=True):
        assert part == pytest.approx(ln.substring(xy, a, b))


def test_gap_lines_of_many_pieces_do_not_depend_on_noise(spark):
    """Pieces along a border of sectors stay in one cluster whatever the last bits of their ends."""
    from roadloom.operators import clustering

    rows = [(k, [(1.5, 10.0 + k), (1.5 + (k % 2) * -2e-16, 30.0 + k)]) for k in range(6)]
    assert [r.support for r in clustering.gap_lines(spark.createDataFrame(rows, f"id long, line {ln.LINE}")).collect()] == [pytest.approx(6.0)]
