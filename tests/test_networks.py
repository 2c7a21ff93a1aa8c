"""Network operators against brute force or hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import carriageways, centerlines, checks, clustering, overlay, refine, roundabouts, scores, scoring, spatial, topology
from roadloom.operators import lines as ln
from roadloom.plans import algorithms
from roadloom.sources import bundles, maps, traces

NET = f"id long, line {ln.LINE}, source string, support double"


def net(spark, *rows):
    return spark.createDataFrame([(i, p, *(more or ("VPD", 1.0))) for i, p, *more in rows], NET)


def ids(d):
    return {r.id for r in d.collect()}


def test_chains_and_greedy_paths(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (10, 11), (11, 12), (12, 10)]
    e = spark.createDataFrame([(u, v, 5, 1, 1, 10.0, 1.0) for u, v in links] + [(2, 1, 2, 1, 1, 10.0, 1.0)], "u long, v long, support long, vpd_support long, hpd_support long, mean_speed double, heading_consistency double")
    got = sorted(tuple(r.node_path) for r in centerlines.chains(e).collect())
    assert got == [(1, 2, 3, 4), (4, 5), (4, 6), (10, 11, 12, 10)]
    s = {tuple(r.node_path): (r.support, r.fw, r.rv, r.dir_travel) for r in centerlines.chains(e).join(centerlines.path_statistics(centerlines.chains(e), e), "path").collect()}
    assert s[1, 2, 3, 4] == (17, 15, 2, "B") and s[4, 5] == (5, 5, 0, "T")
    greedy = [tuple(r.node_path) for r in centerlines.greedy_paths(e).collect()]
    steps = [x for p in greedy for x in zip(p[:-1], p[1:], strict=True)]
    assert sorted(steps) == sorted([*links, (2, 1)]) and all(len(set(p)) == len(p) for p in greedy)


def test_selection_rules(spark):
    rows = [(1, 2, 50.0, 49.0, 9.0), (2, 3, 4.0, 4.0, 1.0), (3, 4, 40.0, 40.0, 2.5), (2, 5, 60.0, 55.0, 4.0), (5, 1, 30.0, 30.0, 2.5)]
    d = spark.createDataFrame(rows, "u long, v long, length double, ends_apart double, weighted_support double")
    got = {(r.u, r.v): r for r in scoring.select_candidates(d).collect()}
    assert [got[k].selection_reason for k in ((1, 2), (2, 3), (3, 4), (2, 5))] == ["force_keep_support", "drop_short_low_support", "drop_dangling_weak", "score_threshold"]
    x = got[2, 5]
    assert x.selection_score == pytest.approx(0.30 * 0.5 + 0.15 * min(1, 4 / 60 / 0.15) + 0.30 * 1 + 0.25 * max(5 / 8, 0.55))


def test_refinement_steps(spark):
    d = net(
        spark,
        (1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(100.0, 0.0), (200.0, 0.0)]), (3, [(100.0, 0.0), (100.0, 90.0)]), (4, [(100.0, 0.0), (100.0, -6.0)]),
        (5, [(218.0, 0.0), (300.0, 2.0)]), (6, [(0.0, 300.0), (4.0, 304.0), (8.0, 300.0), (4.0, 296.0), (1.0, 299.0)]), (7, [(500.0, 0.0), (502.0, 0.0)]),
    )
    assert {(r.degree, len(r.members)) for r in refine.intersections(d).collect()} == {(4, 4)}
    assert ids(refine.without_spurs(d)) == {1, 2, 3, 5, 6, 7}
    assert ids(refine.without_loops(d)) == {1, 2, 3, 5}  # lines under 10 end where they begin, by this rule
    assert ids(refine.without_stubs(d)) == {1, 2, 3, 4, 5, 6}
    joined = refine.stitched(d.where("id IN (1, 2, 3, 5)"))
    lines = {r.id: [(p.x, p.y) for p in r.line] for r in joined.collect()}
    assert lines[2] == [(100.0, 0.0), (200.0, 0.0), (218.0, 0.0), (300.0, 2.0)] and set(lines) == {1, 2, 3}
    b = refine.bridges(net(spark, (1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(120.0, -50.0), (120.0, 50.0)]))).collect()
    assert [[(p.x, p.y) for p in r.line] for r in b if r.line[0].x == 100.0] == [[(100.0, 0.0), (120.0, 0.0)]]
    ends = {tuple((round(p.x, 6), p.y) for p in r.line) for r in refine.snapped_ends(net(spark, (1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(104.0, 0.0), (200.0, 0.0)]))).collect()}
    assert ends == {((0.0, 0.0), (102.0, 0.0)), ((102.0, 0.0), (200.0, 0.0))}
    cross = net(spark, (1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(50.0, -30.0), (50.0, 30.0)]), (3, [(0.0, 90.0), (90.0, 90.0)]))
    assert {r.id: r.z_level for r in refine.with_levels(cross).collect()} == {1: 0, 2: 1, 3: 0}
    twin = net(spark, (1, [(0.0, 0.0), (100.0, 0.0)], "VPD", 3.0), (2, [(0.0, 2.0), (90.0, 2.0)], "VPD", 1.0), (3, [(0.0, 1.0), (100.0, 1.0)], "roundabout", 0.1))
    assert ids(refine.without_parallel(twin)) <= {1, 3} and 3 in ids(refine.without_parallel(twin))


def test_splitting_and_topology(spark):
    cross = net(spark, (1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(50.0, -30.0), (50.0, 30.0)]))
    parts = sorted((r.id, [(p.x, p.y) for p in r.line]) for r in topology.noded(cross).collect())
    assert parts == [(1, [(0.0, 0.0), (50.0, 0.0)]), (1, [(50.0, 0.0), (100.0, 0.0)]), (2, [(50.0, -30.0), (50.0, 0.0)]), (2, [(50.0, 0.0), (50.0, 30.0)])]
    nodes = topology.junction_nodes(cross)
    assert sorted((r.kind, r.degree) for r in nodes.collect()) == [("crossing", 2), *[("end", 1)] * 4]
    h = {(r.id, r.end): round(r.heading) % 360 for r in topology.end_headings(cross).collect()}
    assert h == {(1, 0): 0, (1, 1): 180, (2, 0): 90, (2, 1): 270}
    g = topology.rounded_graph(topology.noded(cross))
    assert g.count() == 4
    m = scores.topology_metrics(topology.noded(cross)).first()
    assert (m.nodes, m.edges, m.components, m.dead_ends, m.junctions) == (5, 4, 1, 4, 1)
    line = topology.mean_line([np.array([(0.0, 0.0), (100.0, 0.0)]), np.array([(100.0, 4.0), (0.0, 4.0)]), np.array([(0.0, 2.0), (100.0, 2.0)])], np.ones(3))
    assert line[:, 1] == pytest.approx(2.0) and line[0, 0] == 0


def test_roundabout(spark):
    r = random.Random(3)
    rows = []
    for k in range(6):
        a = k * math.pi / 3
        ring = [(50 + 20 * math.cos(a + t / 5), 50 + 20 * math.sin(a + t / 5)) for t in range(22)]
        rows.append((k, ring))
    rows.append((9, [(float(x), 200 + r.uniform(-0.1, 0.1)) for x in range(0, 300, 10)]))
    d = spark.createDataFrame(rows, f"id long, line {ln.LINE}")
    c = roundabouts.candidates(roundabouts.arcs(d))
    x = c.collect()
    assert len(x) == 1 and (x[0].x, x[0].y, x[0].r) == pytest.approx((50, 50, 20), abs=1.0)
    points = d.select("id", F.explode("line").alias("p")).select("id", "p.x", "p.y")
    assert roundabouts.validated(c, points).count() == 1
    lines = net(spark, (1, [(45.0, 50.0), (55.0, 50.0)]), (2, [(75.0, 50.0), (200.0, 50.0)]))
    out = {r.id: r for r in roundabouts.with_roundabouts(lines, c).collect()}
    assert 1 not in out and out[2].line[0].x == pytest.approx(70, abs=1.5) and len(out) == 2
    assert spark.range(1).select(roundabouts.distinct_directions(F.array(F.lit(0.0), F.lit(10.0), F.lit(90.0), F.lit(200.0)))).first()[0] == 3


def test_double_lines(spark):
    d = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(0.0, 2.0), (98.0, 2.0)]), (3, [(100.0, 3.0), (0.0, 3.0)]), (4, [(0.0, 90.0), (100.0, 90.0)])], f"id long, line {ln.LINE}")
    assert [(r.a, r.b) for r in carriageways.parallel_pairs(d).collect()] == [(1, 2)]
    assert {(r.a, r.b) for r in carriageways.opposite_pairs(d).collect()} == {(1, 3), (2, 3)}
    assert carriageways.single_lines(d).count() == 3
    out = carriageways.without_opposites(d)
    assert out.count() == 3
    assert ln.offset(np.array([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), 1.0) == pytest.approx(np.array([(0.0, 1.0), (9.0, 1.0), (9.0, 10.0)]))
    way = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 200.0), (2, 10.0), (2, 190.0)], "component long, azimuth double")
    assert {r.component: r.kind for r in way.groupBy("component").agg(carriageways.road_direction("azimuth").alias("kind")).collect()} == {1: "unidirectional", 2: "bidirectional"}
    assert {(r.component, r.azimuth) for r in carriageways.majority(way).collect()} == {(1, 10.0), (1, 20.0), (2, 10.0)}


def test_density_clusters_equal_brute_force(spark):
    r = random.Random(5)
    pts = [(k, r.gauss(20 * (k % 3), 2), r.gauss(0, 2)) for k in range(90)] + [(100 + k, r.uniform(-50, 90), r.uniform(-60, 60)) for k in range(30)]
    eps, least = 2.0, 4
    near = {a[0]: [b[0] for b in pts if math.hypot(a[1] - b[1], a[2] - b[2]) <= eps] for a in pts}
    core = {k for k, v in near.items() if len(v) >= least}
    label = {}
    for k in sorted(core):
        if k not in label:
            todo = [k]
            while todo:
                i = todo.pop()
                if i not in label:
                    label[i] = k
                    todo += [j for j in near[i] if j in core]
    got = {x.id: x.cluster for x in clustering.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), eps, least).collect()}
    assert {k: got[k] for k in core} == label
    assert set(got) == core | {k for k in near if any(j in core for j in near[k])}


def test_thinning_and_skeleton(spark):
    bar = np.zeros((20, 40), bool)
    bar[8:13, 5:35] = True
    t = clustering.thinned(bar)
    assert t.sum(axis=0)[8:32].max() == 1 and t[:, 10:30].any(axis=0).all()
    pts = spark.range(4000).select((F.col("id") % 400).cast("double").alias("x"), (100 + F.floor(F.col("id") / 400)).cast("double").alias("y"))
    lines = clustering.skeleton_lines(clustering.skeleton(pts), 5.0).collect()
    assert len(lines) == 1 and abs(lines[0].line[-1].x - lines[0].line[0].x) > 300


def test_splines_and_shapes():
    t = np.linspace(0, 3, 40)
    curve = np.column_stack((30 * t, 20 * np.sin(t)))
    out = ln.bspline(curve, 60, 2.0)
    assert len(out) == 60 and np.abs(np.interp(out[:, 0], curve[:, 0], curve[:, 1]) - out[:, 1]).max() < 1
    assert [len(x) for x in ln.chunk_by_length(np.array([(0.0, 0), (15, 0), (30, 0), (32, 0)]), 20)] == [3, 2]
    box = ln.clip_to_box(np.array([(-10.0, 5.0), (30.0, 5.0), (30.0, 50.0)]), (0.0, 0.0, 20.0, 20.0))
    assert [p.tolist() for p in box] == [[[0.0, 5.0], [20.0, 5.0]]]
    circle = np.column_stack((np.cos(np.linspace(0, 2 * np.pi, 60)), np.sin(np.linspace(0, 2 * np.pi, 60)))) * 10
    assert ln.curvatures(circle) == pytest.approx(0.1, abs=1e-3)
    assert len(ln.arc_runs(circle)) == 1 and roundabouts.fitted_circle(circle)[2] == pytest.approx(10)


def test_scores_of_a_shifted_copy(spark):
    truth = net(spark, (1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(100.0, 0.0), (100.0, 100.0)]))
    same, far = scores.buffer_score(truth, truth).first(), scores.buffer_score(net(spark, (1, [(0.0, 40.0), (60.0, 40.0)])), truth, 5.0).first()
    assert (same.precision, same.recall, same.f1) == pytest.approx((1, 1, 1)) and (far.precision, far.f1) == (0, 0)
    half = scores.buffer_score(net(spark, (1, [(0.0, 1.0), (50.0, 1.0)])), truth, 1.0 + 1e-9).first()
    assert half.precision == pytest.approx(1) and half.recall == pytest.approx(0.25, abs=1e-3)
    assert scores.path_similarity(truth, truth, 3).first().apls == pytest.approx(1)
    p = {(r.source, r.node): r.dist for r in scores.shortest_paths(spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0)], "u long, v long, length double"), spark.createDataFrame([(1,)], "node long")).collect()}
    assert p == {(1, 1): 0, (1, 2): 5, (1, 3): 10}
    a = spark.createDataFrame([(1, 1), (2, 3)], "node long, degree long")
    assert scores.degree_divergence(a, a).first().similarity == pytest.approx(1)
    assert scores.clean_radii([3, -1, float("nan"), 3]) == [3.0] and scores.clean_radii([]) == [8.0, 15.0]


def test_nearest_any_equals_brute_force(spark):
    r = random.Random(1)
    a, b = ([(k, r.uniform(0, 1000), r.uniform(0, 1000)) for k in range(40)] for _ in range(2))
    da, db = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    got = {x.a: (x.b, x.dist) for x in spatial.nearest_any(da, db, 3.0).collect()}
    assert got == {p[0]: (q[1], pytest.approx(q[0])) for p in a for q in [min((math.hypot(p[1] - o[1], p[2] - o[2]), o[0]) for o in b)]}


def test_maps_checks_and_algorithms(spark, tmp_path):
    raw = spark.createDataFrame([("1", "2", "MULTILINESTRING ((0 0, 10 0), (5 5, 6 6))"), ("x", "3", "oops"), ("3", "1", "LINESTRING (-5 1, 50 1)")], "func_class string, road_link_id string, geom string")
    m = maps.road_map(raw, (2.0, -1.0, 4.0, 2.0))
    assert sorted((r.func_class, r.geom_part) for r in m.collect()) == [(1, 0), (3, 0)]
    (tmp_path / "box.txt").write_text("box of the area: [21.0, 42.5, 21.2, 42.7]")
    assert maps.read_box(spark, str(tmp_path / "box.txt")) == (21.0, 42.5, 21.2, 42.7)
    roads = traces.grid_roads(spark).withColumn("ref_node_pvid", F.col("id")).withColumn("nref_node_pvid", F.lit(99)).withColumn("dir_travel", F.lit(" both"))
    links, nodes = maps.ground_truth(roads)
    assert links.first().dir_travel == "B" and nodes.count() == 21
    bad = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0)]), (2, [(0.0, 0.0)]), (3, None)], f"trace_id long, line {ln.LINE}")
    assert checks.geometry(bad, "x").first().bad == 2 and checks.valid(bad).count() == 1
    assert algorithms.available() == ["cells", "skeleton", "windows"]
    with pytest.raises(ValueError):
        algorithms.settings_of("cells", nothing=1)
    with pytest.raises(ValueError):
        algorithms.settings_of("none")
    p = traces.points(spark, "/root/testdata/sf0.001")
    result = algorithms.generate("skeleton", p, traces.lines(p))
    bundles.write_result(result, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "centerlines")).count() > 0 and spark.read.json(str(tmp_path / "out" / "summary")).first().setting_algorithm == "skeleton"


def test_empty_networks(spark):
    none = net(spark, (1, [(0.0, 0.0), (1.0, 1.0)])).where("false")
    for step in (refine.without_spurs, refine.snapped_ends, refine.stitched, refine.bridged, refine.without_stubs, refine.without_parallel, refine.smoothed):
        assert step(none).count() == 0
    assert overlay.within(none, none, 5.0).count() == 0 and topology.noded(none).count() == 0
