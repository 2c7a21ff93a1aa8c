import random, numpy as np, math, pytest
from pyspark.sql import functions as F
from roadloom.operators import overlay
from roadloom.operators.lines import LINE, along, at_distance
from roadloom.operators.kernels import point_line_distances


def network(seed, n, size=100.0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.uniform(0, size), r.uniform(0, size)
        pts = [(x, y)]
        for _ in range(r.randint(1, 5)):
            x, y = x + r.uniform(-30, 30), y + r.uniform(-30, 30)
            pts.append((x, y))
        out.append((k, pts))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, f"id long, line {LINE}")


def test_overlay_equals_dense_sampling(spark):
    a, b = network(1, 12), network(2, 12)
    da, db = table(spark, a), table(spark, b)
    lines = {k: np.array(p) for k, p in a}
    others = [np.array(p) for _, p in b]
    r = 6.0
    near = {}
    for k, xy in lines.items():
        s = np.linspace(0, along(xy)[-1], 4001)
        d = np.array([point_line_distances(at_distance(xy, s), o) for o in others])
        near[k] = (d.min(axis=0) <= r).mean() * along(xy)[-1], d.min(axis=1)
    got = {x.id: x for x in overlay.length_within(da, db, r).collect()}
    for k, xy in lines.items():
        assert got[k].total == pytest.approx(along(xy)[-1])
        assert got[k].inside_length == pytest.approx(near[k][0], abs=0.2)
    rest = {}
    for x in overlay.uncovered_stretches(da, db, r).collect():
        rest[x.id] = rest.get(x.id, 0) + x.hi - x.lo
    assert all(rest.get(k, 0) == pytest.approx(got[k].total - got[k].inside_length, abs=1e-6) for k in lines)
    pairs = {(x.a, x.b): x.dist for x in overlay.within(da, db, r).collect()}
    want = {(k, j): d for k in lines for j, d in enumerate(near[k][1])}
    for key, d in want.items():
        if d <= r - 0.05:
            assert pairs[key] == pytest.approx(d, abs=0.05)
        elif d > r + 0.05:
            assert key not in pairs
    assert {x.id for x in overlay.without_near(da, db, r).collect()} == set(lines) - {k for k, _ in pairs}
    pts = [(k, random.Random(k).uniform(0, 100), random.Random(k + 500).uniform(0, 100)) for k in range(60)]
    hit = {x.pid: (x.id, x.dist) for x in overlay.nearest_on_lines(spark.createDataFrame(pts, "pid long, x double, y double"), da, 15.0).collect()}
    for k, x, y in pts:
        best = min((float(point_line_distances(np.array([(x, y)]), xy)[0]), j) for j, xy in lines.items())
        assert (k in hit) == (best[0] <= 15) and (k not in hit or hit[k][1] == pytest.approx(best[0]))


def test_crossings_of_lines(spark):
    d = table(spark, [(1, [(0.0, 0.0), (300.0, 300.0)]), (2, [(0.0, 300.0), (300.0, 0.0)]), (3, [(400.0, 0.0), (500.0, 0.0)])])
    rows = overlay.crossing_points(d).collect()
    assert [(x.a, x.b, round(x.x, 6), round(x.y, 6), round(x.a_at, 6)) for x in rows] == [(1, 2, 150.0, 150.0, round(150 * math.sqrt(2), 6))]
    long_one = table(spark, [(1, [(0.0, 0.0), (3000.0, 3000.0)])])
    assert overlay._cells(overlay.segments(long_one), 20.0, 1.0).count() < 3000


def test_mean_distance_and_ends(spark):
    d = table(spark, [(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(0.0, 3.0), (100.0, 5.0)])])
    p = spark.createDataFrame([(1, 2)], "a long, b long")
    assert overlay.mean_distance(d, d, p, 2.0).first().mean_dist == pytest.approx(4.0, abs=0.05)
    e = {(x.id, x.end): x.heading for x in overlay.ends(d.where("id = 1")).collect()}
    assert e == {(1, 0): 270.0, (1, 1): 90.0}


def test_segment_pairs_once_each(spark):
    """Whatever the cell, each pair of segments comes once, and those within the radius all come."""
    a, b = overlay.segments(table(spark, network(3, 25))), overlay.segments(table(spark, network(4, 25)))
    for cell in (7.0, 20.0, 200.0):
        got = [tuple(r) for r in overlay.near_segments(a, b, 5.0, cell).select("a_id", "a_seq", "b_id", "b_seq").collect()]
        assert len(got) == len(set(got))
        near = overlay.near_segments(a, b, 5.0, 1000.0).withColumns(overlay._sides()).where(overlay.segment_distance() <= 5.0)
        assert {tuple(r) for r in near.select("a_id", "a_seq", "b_id", "b_seq").collect()} <= set(got)


def test_crossings_as_in_sql(spark):
    """Steps of one course seem to meet by rounding where they share a cell of 30; halves round as DuckDB rounds them."""
    from roadloom.functions import geometry as g
    from roadloom.operators import cleaning

    xy = [(-2.8000000000000003, 33.7), (-1.5, 23.2), (-0.2, 12.7), (1.1, 2.2), (2.4000000000000004, -14.4)]
    d = table(spark, [(390, xy), (930, xy)]).withColumnRenamed("id", "trace_id")
    got = {(round(r.x, 4), round(r.y, 4)) for r in cleaning.line_crossings(d).collect()}
    assert (-0.2, 12.7) in got
    assert {(r.cx, r.cy): r.crossings for r in cleaning.junctions(d).collect()}[0, 0] == 2
    rows = [(1200.0000005,), (-0.5,), (0.1234565,), (12.3,), (0.0,)]
    import duckdb

    want = [duckdb.sql(f"SELECT round(CAST({v!r} AS DOUBLE), 6)").fetchall()[0][0] for (v,) in rows]
    assert [r[0] for r in spark.createDataFrame(rows, "v double").select(g.half_away("v", 6)).collect()] == want


@pytest.mark.parametrize("turn", [None, 30.0])
def test_linked_points_equal_all_pairs(spark, turn):
    from roadloom.operators import spatial

    r = random.Random(11)
    pts = [(k, r.uniform(-60, 60), r.uniform(-60, 60), r.uniform(0, 360) if k % 2 else r.choice([0.0, 14.0, 355.0])) for k in range(300)] + [(1000 + k, r.gauss(200, 3), r.gauss(0, 3), 5.0) for k in range(400)]
    d = spark.createDataFrame(pts, "id long, x double, y double, heading double")
    for reach in (4.0, 7.0):
        parent = {p[0]: p[0] for p in pts}

        def find(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for i, p in enumerate(pts):
            for q in pts[:i]:
                if math.hypot(p[1] - q[1], p[2] - q[2]) <= reach and (turn is None or abs((p[3] - q[3] + 180) % 360 - 180) <= turn):
                    u, v = find(p[0]), find(q[0])
                    parent[max(u, v)] = min(u, v)
        got = spatial._gridded(d, reach, turn).join(spatial.linked(d, reach, turn), ["kx", "ky", "kh"])
        assert {x.id: x.component for x in got.collect()} == {p[0]: find(p[0]) for p in pts}


@pytest.mark.parametrize("turn", [None, 30.0])
def test_density_clusters_without_pairs(spark, turn):
    """Against brute force, with a crowd whose pairs would be 80000; the plan pairs only the thin cells' points."""
    from roadloom.operators import clustering

    r = random.Random(12)
    pts = [(k, r.uniform(-40, 40), r.uniform(-40, 40), r.uniform(0, 360)) for k in range(250)] + [(1000 + k, r.gauss(200, 2), r.gauss(0, 2), r.gauss(0, 4) % 360) for k in range(400)]
    d = spark.createDataFrame(pts, "id long, x double, y double, heading double")
    eps, least = 6.0, 4
    near = {p[0]: [(math.hypot(p[1] - q[1], p[2] - q[2]), q[0]) for q in pts if p != q and math.hypot(p[1] - q[1], p[2] - q[2]) <= eps and (turn is None or abs((p[3] - q[3] + 180) % 360 - 180) <= turn)] for p in pts}
    core, want = {k for k, n in near.items() if len(n) + 1 >= least}, {}
    for k in sorted(core):
        todo = [k] if k not in want else []
        while todo:
            u = todo.pop()
            if u not in want:
                want[u] = k
                todo += [v for _, v in near[u] if v in core]
    want |= {k: want[min((x, v) for x, v in n if v in core)[1]] for k, n in near.items() if k not in core and any(v in core for _, v in n)}
    assert {x.id: x.cluster for x in clustering.density_clusters(d, eps, least, turn).collect()} == want


def test_polyline_of_a_crowd(spark):
    """2000 points on a short road are two million pairs; their line needs none of them."""
    from roadloom.operators import clustering

    d = spark.range(2000).selectExpr("id", "(id % 100) * 0.5 AS x", "(id % 7) * 0.1 AS y", "88.0 + id % 5 AS heading")
    rows = clustering.cluster_polylines(d, 6.0, 4).collect()
    assert [r.support for r in rows] == [2000] and rows[0].line[-1].x - rows[0].line[0].x > 40
