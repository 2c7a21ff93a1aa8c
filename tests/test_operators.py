import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadloom.operators import cleaning, network, spatial, windows
from roadloom.operators.graph import connected_components
from roadloom.plans import queries as plans
from roadloom.sources import traces

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    want = con.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    rows = sorted(map(str, want.fetchall()))
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == rows


#: Queries that may find nothing among 15 traces of 15 different roads.
FEW = {"density_clusters", "density_lines", "duplicate_carriageways", "opposite_pairs", "parallel_pairs", "roundabout_candidates"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0 or name in FEW


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_components(spark, limit):
    r = random.Random(1)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(80)] + [(k, k + 1) for k in range(200, 240)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    d = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in connected_components(d, single_task_edges=limit).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(d.where("false"), single_task_edges=limit).count() == 0


def cloud(spark, n, seed):
    r = random.Random(seed)
    rows = [(k, r.uniform(-20, 20), r.uniform(-20, 20)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def test_joins_equal_brute_force(spark):
    a, da = cloud(spark, 150, 1)
    b, db = cloud(spark, 130, 2)
    dist = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    near = {(p[0], q[0]) for p in a for q in b if dist(p, q) <= 3}
    assert {(r.a, r.b) for r in spatial.within(da, db, 3.0).collect()} == near
    assert {(r.a, r.b) for r in spatial.pairs(da, 3.0).collect()} == {(p[0], q[0]) for p, q in itertools.combinations(a, 2) if dist(p, q) <= 3}
    assert {r.id for r in spatial.covered(da, db, 3.0, yes=False).collect()} == {p[0] for p in a} - {x for x, _ in near}
    used_a, used_b, want = set(), set(), set()
    for _, x, y in sorted((dist(a[x], b[y]), x, y) for x, y in near):
        if x not in used_a and y not in used_b:
            used_a.add(x), used_b.add(y), want.add((x, y))
    assert {(r.a, r.b) for r in spatial.match_one_to_one(da, db, 3.0).collect()} == want


def test_transitive_pruning(spark):
    e = spark.createDataFrame([(1, 2, 5, 50.0), (2, 3, 5, 50.0), (1, 3, 1, 19.0), (3, 4, 1, 10.0)], "u long, v long, support long, length double")
    assert {(r.u, r.v) for r in network.prune_transitive(e, 1.2, 3, 1).collect()} == {(1, 2), (2, 3), (3, 4)}


def test_raw_traces(spark):
    raw = spark.createDataFrame(
        [("a", "Yes", "LINESTRING (21.1 42.6, 21.2 42.7)", "[1, 2]", "bad", None, "2", "3", "90000", None, "1.5", None), ("b", "no", "LINESTRING (0 0, 1 1)", *[None] * 9), ("c", "1", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", *[None] * 9), ("d", "true", "oops", *[None] * 9)],
        traces.VPD_SCHEMA,
    )
    got = {r.trace_id: r for r in traces.vehicle_paths(raw).collect()}
    assert set(got) == {"a", "c_p0", "c_p1"}
    assert (got["a"].hour, got["a"].construction_percent, got["a"].path_quality_score, got["a"].altitudes) == (1, 0.0, 1.0, [1.0, 2.0])
    hpd = spark.createDataFrame([("t", "1", "00:00:02", "1", "1", "10", "0"), ("t", "1", "00:00:01", "0", "0", "20", "0"), ("t", "1", "nope", "9", "9", "1", "0"), ("u", "1", "00:00:01", "0", "0", "1", "0")], traces.HPD_SCHEMA)
    row = traces.probe_traces(hpd).collect()
    assert len(row) == 1 and [p.x for p in row[0].line] == [0, 1] and row[0].median_speed == 15
    fused = traces.fuse(traces.vehicle_paths(raw), traces.probe_traces(hpd).withColumn("trace_id", F.col("traceid")))
    assert fused.count() == 4


def test_substrings_keep_inner_vertices(spark):
    d = spark.createDataFrame([(1, [(0.0, 0.0), (25.0, 0.0), (25.0, 5.0)])], "trace_id long, line array<struct<x:double,y:double>>")
    got = {r.part: [c for p in r.line for c in (p.x, p.y)] for r in windows.substrings(d, 20.0).collect()}
    assert got[0] == pytest.approx([0, 0, 15, 0]) and got[1] == pytest.approx([15, 0, 25, 0, 25, 5])


def test_whole_table_joins_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(k, r.uniform(-20, 20), r.uniform(-20, 20), r.choice(["VPD", "HPD"])) for k in range(1, 300)]
    p = spark.createDataFrame(rows, "event_id long, x double, y double, source string")
    dist = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    v, h = ([x for x in rows if x[3] == s] for s in ("VPD", "HPD"))
    near = lambda a: min((dist(a, b), b[0]) for b in h)
    hit = {a[0] for a in v if near(a)[0] <= 2}
    assert {(x.a, x.b) for x in plans.pairs_within(p).collect()} == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if dist(a, b) <= 4}
    assert {(x.a, x.b) for x in plans.nearest_probe(p).collect()} == {(a[0], near(a)[1]) for a in v if near(a)[0] <= 3}
    assert {x.id for x in plans.covered_points(p).collect()} == hit
    assert {x.id for x in plans.uncovered_points(p).collect()} == {a[0] for a in v} - hit
    used_a, used_b, want = set(), set(), set()
    for d, x, y in sorted((dist(a, b), a[0], b[0]) for a in v for b in h):
        if d <= 2 and x not in used_a and y not in used_b:
            used_a.add(x), used_b.add(y), want.add((x, y))
    assert {(x.a, x.b) for x in plans.one_to_one_match(p).collect()} == want


def test_transitive_pruning_of_every_edge_over_four_hops(spark):
    r = random.Random(8)
    xy = {k: (r.uniform(0, 100), r.uniform(0, 100)) for k in range(14)}
    w = {(u, v): ((xy[u][0] - xy[v][0]) ** 2 + (xy[u][1] - xy[v][1]) ** 2) ** 0.5 for u in xy for v in xy if u != v and r.random() < 0.35}
    w |= {(100 + k, 101 + k): 10.0 for k in range(4)} | {(100, 104): 39.0} | {(200 + k, 201 + k): 10.0 for k in range(5)} | {(200, 205): 49.0}
    e = spark.createDataFrame([(u, v, 50, d * 50) for (u, v), d in w.items()], "u long, v long, support long, length double")

    def replaced(s, t):
        reach = {s: 0.0}
        for _ in range(4):
            best = {}
            for (u, v), d in w.items():
                if u in reach and {u, v} != {s, t} and reach[u] + d <= 1.2 * w[s, t]:
                    best[v] = min(best.get(v, 1e9), reach[u] + d)
            if t in best:
                return True
            reach = best
        return False

    gone = {x for x in w if replaced(*x)}
    assert (100, 104) in gone and (200, 205) not in gone and len(gone) > 5
    assert {(x.u, x.v) for x in network.prune_transitive(e).collect()} == set(w) - gone


def test_matching_of_a_long_chain(spark):
    at, rows = 0.0, []
    for k in range(106):
        rows.append((k, at, 0.0))
        at += 2.0 - k / 100
    a, b = (spark.createDataFrame(rows[s::2], "id long, x double, y double") for s in (0, 1))
    got = {(x.a, x.b) for x in spatial.match_one_to_one(a, b, 2.5).collect()}
    assert got == {(k, k + 1) for k in range(0, 106, 2)}


def test_crossings_and_duplicates_of_whole_lines(spark):
    rows = [
        (1, [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0)]),
        (2, [(25.0, -10.0), (25.0, 10.0)]),  # crosses the first leg of 1, not its chord
        (3, [(10.0, 60.0), (10.0, 5.0)]),  # crosses the chord of 1 only
        (4, [(60.0, -10.0), (50.0, 0.0), (40.0, 10.0)]),  # meets 1 in a vertex of both
        (5, [(25.0, 0.0), (25.0, 1.0)]),  # ends on 1 and lies along 2
        (6, [(0.0, 200.0), (100.0, 300.0), (0.0, 400.0)]),
        (7, [(8.0, 200.0), (108.0, 300.0), (8.0, 400.0)]),  # its chord lies 8 from that of 6, as do all points
        (8, [(500.0, 0.0), (500.0, 60.0), (560.0, 60.0)]),
        (9, [(500.0, 1.0), (500.0, 61.0), (560.0, 61.0)]),
    ]
    lines = spark.createDataFrame(rows, "trace_id long, line array<struct<x:double,y:double>>")
    got = sorted((r.a, r.b, r.x, r.y) for r in cleaning.line_crossings(lines).where("a < 8").collect())
    assert got == [(1, 2, 25.0, 0.0), (1, 4, 50.0, 0.0)]
    assert {(r.a, r.b) for r in cleaning.duplicate_pairs(lines, 10.0).collect()} == {(2, 5), (6, 7), (8, 9)}
    bowed = [(1, [(0.0, 0.0), (300.0, 0.0), (300.0, 100.0), (0.0, 100.0), (0.0, 60.0)]), (2, [(30.0, 0.0), (300.0, 0.0), (300.0, 100.0), (0.0, 100.0), (0.0, 90.0)])]
    lines = spark.createDataFrame(bowed, "trace_id long, line array<struct<x:double,y:double>>")
    assert {(r.a, r.b) for r in cleaning.duplicate_pairs(lines, 31.0, 40.0).collect()} == {(1, 2)}


def test_matching_of_crowded_places_lists_no_pairs(spark):
    """Many points of one place and equal distances: the greedy order holds, and 600,000 pairs within the radius are not listed."""
    r = random.Random(11)
    places = [(0.1 * r.randint(0, 40), 0.1 * r.randint(0, 40)) for _ in range(60)]
    rows = [(k, *r.choice(places)) for k in range(900)]
    a, b = rows[::2], rows[1::2]
    da, db = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    used_a, used_b, want = set(), set(), set()
    for _, x, y in sorted((float(np.hypot(p[1] - q[1], p[2] - q[2])), p[0], q[0]) for p in a for q in b):
        if _ <= 2 and x not in used_a and y not in used_b:
            used_a.add(x), used_b.add(y), want.add((x, y))
    got = spatial.match_one_to_one(da, db, 2.0)
    assert {(x.a, x.b) for x in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().toString()


def test_matching_across_tiles(spark):
    """Chains of points through many tiles, with ends in doubt until others are settled."""
    r = random.Random(3)
    rows = [(k, 0.9 * k * 0.5 + r.uniform(-0.4, 0.4), r.uniform(-1, 1)) for k in range(600)]
    a, b = rows[::2], rows[1::2]
    da, db = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    used_a, used_b, want = set(), set(), set()
    for d, x, y in sorted((float(np.hypot(p[1] - q[1], p[2] - q[2])), p[0], q[0]) for p in a for q in b if abs(p[1] - q[1]) <= 1):
        if d <= 0.8 and x not in used_a and y not in used_b:
            used_a.add(x), used_b.add(y), want.add((x, y))
    assert {(x.a, x.b) for x in spatial.match_one_to_one(da, db, 0.8).collect()} == want
