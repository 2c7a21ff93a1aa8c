"""The registered queries of the trajectory engine on the portable traces, and the same questions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import cleaning, evaluation, kernels, network, scoring, spatial, windows
from roadloom.sources import traces
from roadloom.sources.traces import POINTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the points (or of session and folder) under a name, with its SQL."""

    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(traces.points(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {POINTS_SQL}, " + sql.strip()
        return f

    return put


def r6(c, name: str | None = None) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


_STEP = """st AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step FROM
  (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pts WINDOW w AS (PARTITION BY trace_id ORDER BY pos)))"""
_MOD = lambda a, b: f"(({a}) - ({b}) * floor(({a}) / ({b})))"
_BEARING = lambda dx, dy: _MOD(f"degrees(atan2({dx}, {dy})) + 360", "CAST(360 AS DOUBLE)")
_NODE = "nd AS (SELECT *, CAST(round_even(x / 30, 0) AS BIGINT) * 4294967296 + CAST(round_even(y / 30, 0) AS BIGINT) AS node FROM pts)"
_MOVES = f"""{_NODE}, mv AS (SELECT *, node AS v, {_BEARING("x - px", "y - py")} AS heading FROM
  (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step FROM (SELECT *, lag(node) OVER w AS u, lag(x) OVER w AS px, lag(y) OVER w AS py FROM nd WINDOW w AS (PARTITION BY trace_id ORDER BY pos)))
  WHERE u <> node AND step > 0 AND step <= 50)"""
_EDGES = f"""{_MOVES}, ed AS (SELECT u, v, count(*) AS support, sum(step) AS length, count(*) FILTER (source = 'VPD') AS vpd_support, count(*) FILTER (source = 'HPD') AS hpd_support,
  avg(speed) AS mean_speed, coalesce(stddev_pop(speed) / nullif(avg(speed), 0), 0) AS speed_cv, sqrt(pow(avg(sin(radians(heading))), 2) + pow(avg(cos(radians(heading))), 2)) AS heading_consistency,
  count(DISTINCT trace_id) AS traces, count(DISTINCT hour) AS hours FROM mv GROUP BY u, v)"""


def moves(p: DataFrame) -> DataFrame:
    return network.transitions(network.labelled(p))


def edge_table(p: DataFrame) -> DataFrame:
    return network.edges(moves(p))


@query(
    "traces_summary",
    f"""{_STEP}, a AS (SELECT trace_id, count(*) AS n, sum(step) AS length, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1, avg(speed) AS s FROM st GROUP BY trace_id)
SELECT trace_id, n, round(length, 6) AS length, round(s, 6) AS mean_speed, round({_BEARING("x1 - x0", "y1 - y0")}, 6) AS heading,
  ['N','NE','E','SE','S','SW','W','NW'][CAST(floor(({_BEARING("x1 - x0", "y1 - y0")} + 22.5) / 45) AS BIGINT) % 8 + 1] AS direction FROM a""",
)
def traces_summary(p: DataFrame) -> DataFrame:
    a = windows.steps(p).groupBy("trace_id").agg(
        F.count("*").alias("n"), F.sum("step").alias("length"), *(f(c, "pos").alias(c + k) for c in ("x", "y") for f, k in ((F.min_by, "0"), (F.max_by, "1"))), F.avg("speed").alias("s")
    )
    h = g.bearing("x0", "y0", "x1", "y1")
    return a.select("trace_id", "n", r6("length"), r6("s", "mean_speed"), r6(h, "heading"), g.compass(h).alias("direction"))


@query("cumulative_distance", f"{_STEP} SELECT trace_id, pos, round(sum(coalesce(step, 0)) OVER (PARTITION BY trace_id ORDER BY pos), 6) AS along FROM st")
def cumulative_distance(p: DataFrame) -> DataFrame:
    return windows.cumulative(p).select("trace_id", "pos", r6("along"))


@query(
    "central_headings",
    f"""h AS (SELECT trace_id, pos, coalesce(lag(x) OVER w, x) AS a, coalesce(lag(y) OVER w, y) AS b, coalesce(lead(x) OVER w, x) AS c, coalesce(lead(y) OVER w, y) AS d FROM pts WINDOW w AS (PARTITION BY trace_id ORDER BY pos))
SELECT trace_id, pos, round({_BEARING("c - a", "d - b")}, 6) AS heading FROM h""",
)
def central_headings(p: DataFrame) -> DataFrame:
    return windows.central_headings(p).select("trace_id", "pos", r6("heading"))


@query(
    "gap_sessions",
    f"""{_STEP}, fo AS (SELECT trace_id, pos, CAST(0 AS BIGINT) AS session, CAST(0 AS BIGINT) AS first_pos, second FROM st WHERE pos = 0
  UNION ALL SELECT s.trace_id, s.pos, f.session + CASE WHEN (s.step > 14 OR s.second - f.second > 100000) AND s.pos - f.first_pos >= 2 THEN 1 ELSE 0 END,
    CASE WHEN (s.step > 14 OR s.second - f.second > 100000) AND s.pos - f.first_pos >= 2 THEN s.pos ELSE f.first_pos END, s.second FROM fo f JOIN st s ON s.trace_id = f.trace_id AND s.pos = f.pos + 1)
SELECT trace_id, session, first_pos, count(*) AS n FROM fo GROUP BY ALL""",
)
def gap_sessions(p: DataFrame) -> DataFrame:
    return windows.sessions(windows.trace_arrays(p, "second"), 14.0, 100000)


@query(
    "sliding_windows",
    """n AS (SELECT trace_id, count(*) AS n FROM pts GROUP BY trace_id HAVING count(*) >= 8),
s AS (SELECT trace_id, n, unnest(list_sort(list_distinct(list_concat(range(0, n - 7, 3), [n - 8])))) AS first_pos FROM n)
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY first_pos) - 1 AS win, first_pos, first_pos + 7 AS last_pos FROM s""",
)
def sliding_windows(p: DataFrame) -> DataFrame:
    return windows.sliding(p, 8, 3)


@query(
    "chunks_by_length",
    f"""{_STEP}, fo AS (SELECT trace_id, pos, CAST(0 AS BIGINT) AS chunk, step AS far, step FROM st WHERE pos = 1
  UNION ALL SELECT s.trace_id, s.pos, f.chunk + CASE WHEN f.far >= 20 THEN 1 ELSE 0 END, CASE WHEN f.far >= 20 THEN s.step ELSE f.far + s.step END, s.step FROM fo f JOIN st s ON s.trace_id = f.trace_id AND s.pos = f.pos + 1)
SELECT trace_id, chunk, count(*) + 1 AS points, round(sum(step), 6) AS length FROM fo GROUP BY ALL""",
)
def chunks_by_length(p: DataFrame) -> DataFrame:
    return windows.chunks(traces.lines(p), 20.0).select("trace_id", F.col("chunk").cast("long").alias("chunk"), F.size("line").cast("long").alias("points"), r6(g.line_length("line"), "length"))


_EDGE_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in ("length", "mean_speed", "speed_cv", "heading_consistency"))


@query("edge_graph", f"{_EDGES} SELECT u, v, support, vpd_support, hpd_support, traces, hours, {_EDGE_OUT} FROM ed")
def edge_graph(p: DataFrame) -> DataFrame:
    return edge_table(p).select("u", "v", "support", "vpd_support", "hpd_support", "traces", "hours", *(r6(c) for c in ("length", "mean_speed", "speed_cv", "heading_consistency")))


@query("node_stats", f"{_NODE} SELECT node, round(sum(x * speed) / sum(speed), 6) AS x, round(sum(y * speed) / sum(speed), 6) AS y, round(avg(altitude), 6) AS altitude, round(sum(speed), 4) AS weight, count(*) AS point_count FROM nd GROUP BY node")
def node_stats(p: DataFrame) -> DataFrame:
    return network.nodes(network.labelled(p)).select("node", r6("x"), r6("y"), r6("altitude"), F.round("weight", 4).alias("weight"), "point_count")


@query("node_degrees", f"{_EDGES} SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ed UNION ALL SELECT v FROM ed) GROUP BY node")
def node_degrees(p: DataFrame) -> DataFrame:
    return network.degrees(edge_table(p))


_PRUNED = f"{_EDGES}, pe AS (SELECT a.*, coalesce(b.support, 0) AS reverse_support FROM (SELECT * FROM ed WHERE support >= 2) a LEFT JOIN (SELECT * FROM ed WHERE support >= 2) b ON a.u = b.v AND a.v = b.u), pr AS (SELECT * FROM pe WHERE support >= 0.5 * reverse_support)"


@query("pruned_links", f"{_PRUNED} SELECT u, v, support, reverse_support, round(length, 6) AS length FROM pr")
def pruned_links(p: DataFrame) -> DataFrame:
    return network.prune_weak(edge_table(p), 2, 0.5).select("u", "v", "support", "reverse_support", r6("length"))


_HOP = lambda a: f"""(SELECT s, t, most, v AS node, min(dist + w) AS dist FROM (SELECT * FROM {a} WHERE node <> t) h JOIN hp ON node = u
  WHERE NOT (u = s AND v = t) AND NOT (u = t AND v = s) AND dist + w <= most GROUP BY s, t, most, v)"""  # noqa: E731


@query(
    "transitive_pruned",
    f"""{_PRUNED}, hp AS (SELECT u, v, length / support AS w FROM pr), h0 AS (SELECT u AS s, v AS t, length / support * CAST(1.3 AS DOUBLE) AS most, u AS node, CAST(0 AS DOUBLE) AS dist FROM pr),
h1 AS {_HOP("h0")}, h2 AS {_HOP("h1")}, h3 AS {_HOP("h2")}, h4 AS {_HOP("h3")},
hit AS (SELECT s, t FROM h2 WHERE node = t UNION SELECT s, t FROM h3 WHERE node = t UNION SELECT s, t FROM h4 WHERE node = t)
SELECT u, v, support FROM pr WHERE NOT EXISTS (SELECT 1 FROM hit WHERE s = u AND t = v)""",
)
def transitive_pruned(p: DataFrame) -> DataFrame:
    """Paths of up to 4 hops, every edge a candidate."""
    return network.prune_transitive(network.prune_weak(edge_table(p), 2, 0.5), 1.3, 4).select("u", "v", "support")


_WEIGHED = f"""pw AS (SELECT *, CASE WHEN source = 'VPD' THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight, CAST(floor(second / 86400) AS BIGINT) AS day FROM pts),
nd AS (SELECT *, CAST(round_even(x / 30, 0) AS BIGINT) * 4294967296 + CAST(round_even(y / 30, 0) AS BIGINT) AS node FROM pw),
mv AS (SELECT *, node AS v, {_BEARING("x - px", "y - py")} AS heading FROM
  (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step FROM (SELECT *, lag(node) OVER w AS u, lag(x) OVER w AS px, lag(y) OVER w AS py FROM nd WINDOW w AS (PARTITION BY trace_id ORDER BY pos)))
  WHERE u <> node AND step > 0 AND step <= 50),
no AS (SELECT node, sum(x * speed) / sum(speed) AS x, sum(y * speed) / sum(speed) AS y FROM nd GROUP BY node),
ed AS (SELECT u, v, count(*) FILTER (source = 'VPD') AS vpd, count(*) FILTER (source = 'HPD') AS hpd, sum(weight) AS ws, count(DISTINCT day) AS days,
  count(speed) FILTER (source = 'HPD') AS sn, avg(speed) FILTER (source = 'HPD') AS sm, var_pop(speed) FILTER (source = 'HPD') AS sv, sqrt(pow(avg(sin(radians(heading))), 2) + pow(avg(cos(radians(heading))), 2)) AS r FROM mv GROUP BY u, v),
dg AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ed UNION ALL SELECT v FROM ed) GROUP BY node),
q1 AS (SELECT ed.*, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS length, da.degree + db.degree AS deg, least(1, days / CAST(2 AS DOUBLE)) AS rep,
  CASE WHEN sn > 1 AND sm > 1e-6 THEN greatest(0, least(1, 1 - sqrt(greatest(0, sv)) / greatest(sm, 1e-6) / CAST(0.65 AS DOUBLE))) ELSE 0.5 END AS sc FROM ed JOIN no a ON a.node = u JOIN no b ON b.node = v JOIN dg da ON da.node = u JOIN dg db ON db.node = v),
q2 AS (SELECT *, CAST(0.35 AS DOUBLE) * least(1, ws / greatest(length, 1e-6) / CAST(0.35 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * least(1, deg / CAST(8 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * rep + CAST(0.2 AS DOUBLE) * r AS likeness,
  CAST(0.45 AS DOUBLE) * r + CAST(0.35 AS DOUBLE) * rep + CAST(0.2 AS DOUBLE) * sc AS pc FROM q1),
q3 AS (SELECT *, hpd * pc / (hpd * pc + CAST(1.6 AS DOUBLE) * vpd * CAST(0.6 AS DOUBLE) + 1e-6) / (1 + exp(-6 * (likeness - CAST(0.45 AS DOUBLE)))) AS wp FROM q2)"""


def weighed(p: DataFrame) -> DataFrame:
    return network.labelled(p.withColumn("weight", scoring.point_weight("source", None, None, 0.0)).withColumn("day", F.floor(F.col("second") / 86400)))


def scored_edges(p: DataFrame) -> DataFrame:
    d = weighed(p)
    n = network.nodes(d).select("node", "x", "y")
    e = network.edges(network.transitions(d)).drop("length")
    e = e.join(n.withColumnsRenamed({"node": "u", "x": "x1", "y": "y1"}), "u").join(n.withColumnsRenamed({"node": "v", "x": "x2", "y": "y2"}), "v").withColumn("length", g.distance("x1", "y1", "x2", "y2"))
    return scoring.edge_quality(e)


@query("road_likeness", f"{_WEIGHED} SELECT u, v, round(likeness, 5) AS likeness, round(pc, 5) AS probe_consistency, round(wp, 5) AS w_probe, round(ws * (0.8 + 0.4 * greatest(wp, 1 - wp)) * (0.35 + 0.65 * likeness), 5) AS effective_support FROM q3")
def road_likeness(p: DataFrame) -> DataFrame:
    return scored_edges(p).select("u", "v", *(F.round(c, 5).alias(n) for c, n in (("road_likeness", "likeness"), ("probe_consistency", "probe_consistency"), ("w_probe", "w_probe"), ("effective_support", "effective_support"))))


_HEADINGS = f"""{_STEP}, t AS (SELECT trace_id, any_value(source) AS s0, sum(step) AS length, count(*) AS n, sqrt(pow(avg(sin(radians({_BEARING("x - px", "y - py")}))), 2) + pow(avg(cos(radians({_BEARING("x - px", "y - py")}))), 2)) AS r FROM st GROUP BY trace_id),
l AS (SELECT *, 0.3 + 0.7 / (1 + exp(-(length - 50) / 80)) AS lf FROM t)"""


@query("trace_weights", f"{_HEADINGS} SELECT trace_id, round(greatest(0.1, least(3.0, (1.2 + 0.25 * 0.5 + 0.15 * 0.5) * lf * (0.4 + 0.3 * least(1.0, n / greatest(length, 1.0) * 5) + 0.3 * r))), 5) AS weight, round(greatest(0.1, least(2.0, lf * (0.4 + 0.3 * least(1.0, n / length * 5) + 0.3 * r))), 5) AS raster_weight FROM l")
def trace_weights(p: DataFrame) -> DataFrame:
    d = windows.steps(p).withColumn("h", F.radians(g.bearing("px", "py", "x", "y")))
    t = d.groupBy("trace_id").agg(F.sum("step").alias("length"), F.count("*").alias("n"), F.hypot(F.avg(F.sin("h")), F.avg(F.cos("h"))).alias("r"))
    return t.select("trace_id", F.round(scoring.trace_weight(F.lit("VPD"), "length", "n", "r"), 5).alias("weight"), F.round(scoring.raster_weight("length", "n", "r"), 5).alias("raster_weight"))


@query(
    "weighted_median_speed",
    """c AS (SELECT road, speed, sum(1 + event_id % 3) OVER (PARTITION BY road ORDER BY speed RANGE UNBOUNDED PRECEDING) AS c, sum(1 + event_id % 3) OVER (PARTITION BY road) AS t FROM pts)
SELECT road, min(speed) AS median FROM c WHERE c >= t / 2.0 GROUP BY road""",
)
def weighted_median_speed(p: DataFrame) -> DataFrame:
    return network.weighted_median(p.withColumn("w", 1 + F.col("event_id") % 3), "road", "speed", "w")


@query("density_raster", """SELECT CAST(floor(y / 10) AS BIGINT) AS row, CAST(floor(x / 10) AS BIGINT) AS col, CAST(sum(CASE WHEN speed < 20 THEN 2.0 WHEN speed < 60 THEN 1.0 ELSE 0.5 END) AS DOUBLE) AS w, count(*) AS n FROM pts GROUP BY ALL""".join(["one AS (SELECT 1) ", ""]))
def density_raster(p: DataFrame) -> DataFrame:
    return network.raster(p)


@query(
    "source_complementarity",
    """c AS (SELECT CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 50) AS BIGINT) AS cy, bool_or(source = 'VPD') AS v, bool_or(source = 'HPD') AS h FROM pts GROUP BY ALL)
SELECT CASE WHEN v AND h THEN 'both' WHEN v THEN 'vpd_only' ELSE 'hpd_only' END AS kind, count(*) AS cells FROM c GROUP BY ALL
UNION ALL SELECT 'neither', (max(cx) - min(cx) + 1) * (max(cy) - min(cy) + 1) - count(*) FROM c""",
)
def source_complementarity(p: DataFrame) -> DataFrame:
    return network.complementarity(p, 50.0)


@query(
    "multi_level_cells",
    """t AS (SELECT trace_id, avg(altitude) AS z FROM pts GROUP BY trace_id), c AS (SELECT CAST(floor(x / 20) AS BIGINT) AS cx, CAST(floor(y / 20) AS BIGINT) AS cy, max(z) - min(z) AS rise, count(*) AS n FROM pts JOIN t USING (trace_id) GROUP BY ALL)
SELECT cx, cy, rise, n FROM c WHERE rise > 8 AND n > 5""",
)
def multi_level_cells(p: DataFrame) -> DataFrame:
    """Cells in which the mean heights of traces differ."""
    z = p.groupBy("trace_id").agg(F.avg("altitude").alias("z"))
    c = p.join(z, "trace_id").groupBy(F.floor(F.col("x") / 20).alias("cx"), F.floor(F.col("y") / 20).alias("cy")).agg((F.max("z") - F.min("z")).alias("rise"), F.count("*").alias("n"))
    return c.where("rise > 8 AND n > 5")


@query(
    "length_buckets",
    f"""{_STEP}, l AS (SELECT trace_id, sum(step) AS length FROM st GROUP BY trace_id), b AS (SELECT *, CASE WHEN length >= 500 THEN 7 WHEN length >= 200 THEN 6 WHEN length >= 100 THEN 5 WHEN length >= 50 THEN 4 WHEN length >= 20 THEN 3 WHEN length >= 10 THEN 2 WHEN length >= 5 THEN 1 ELSE 0 END AS bucket FROM l)
SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, round(sum(length), 4) AS total FROM b GROUP BY ALL""",
)
def length_buckets(p: DataFrame) -> DataFrame:
    lengths = windows.steps(p).groupBy("trace_id").agg(F.sum("step").alias("length"))
    return evaluation.length_buckets(lengths).withColumn("total", F.round("total", 4))


@query("step_percentiles", f"{_STEP} SELECT count(step) AS n, round(avg(step), 6) AS mean, round(quantile_cont(step, 0.5), 6) AS median, round(quantile_cont(step, 0.9), 6) AS p90, round(quantile_cont(step, 0.95), 6) AS p95 FROM st WHERE step IS NOT NULL")
def step_percentiles(p: DataFrame) -> DataFrame:
    d = evaluation.distance_summary(windows.steps(p).where("step IS NOT NULL"), "step")
    return d.select("n", *(r6(c) for c in ("mean", "median", "p90", "p95")))


_NEAR = lambda left, right, r: f"""(SELECT l.id AS a, o.id AS b, sqrt((l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y)) AS dist FROM
  (SELECT *, unnest(range(CAST(floor(x / {r}) AS BIGINT) - 1, CAST(floor(x / {r}) AS BIGINT) + 2)) AS cx FROM {left}) l JOIN (SELECT *, CAST(floor(x / {r}) AS BIGINT) AS cx FROM {right}) o ON l.cx = o.cx AND abs(l.y - o.y) <= {r}
  WHERE sqrt((l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y)) <= {r})"""  # noqa: E731
_TWO = "v AS (SELECT event_id AS id, x, y FROM pts WHERE source = 'VPD'), h AS (SELECT event_id AS id, x, y FROM pts WHERE source = 'HPD')"


def two_sources(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All points of either source."""
    ids = p.select(F.col("event_id").alias("id"), "x", "y", "source")
    return ids.where("source = 'VPD'").drop("source"), ids.where("source = 'HPD'").drop("source")


@query("pairs_within", f"s AS (SELECT event_id AS id, x, y FROM pts) SELECT a, b, round(dist, 6) AS dist FROM {_NEAR('s', 's', 4)} WHERE a < b")
def pairs_within(p: DataFrame) -> DataFrame:
    return spatial.pairs(p.select(F.col("event_id").alias("id"), "x", "y"), 4.0).select("a", "b", r6("dist"))


@query("nearest_probe", f"{_TWO} SELECT a, arg_min(b, (round(dist, 9), b)) AS b, round(min(dist), 6) AS dist FROM {_NEAR('v', 'h', 3)} GROUP BY a")
def nearest_probe(p: DataFrame) -> DataFrame:
    return spatial.nearest(*two_sources(p), 3.0).select("a", "b", r6("dist"))


@query("nearest_probe_anywhere", f"{_TWO}, d AS (SELECT v.id AS a, h.id AS b, sqrt((v.x - h.x) * (v.x - h.x) + (v.y - h.y) * (v.y - h.y)) AS dist FROM v, h) SELECT a, arg_min(b, (round(dist, 9), b)) AS b, round(min(dist), 6) AS dist FROM d GROUP BY a")
def nearest_probe_anywhere(p: DataFrame) -> DataFrame:
    """The nearest probe however far: the radius doubles for those that have none yet."""
    return spatial.nearest_any(*two_sources(p), 1.0).select("a", "b", r6("dist"))


@query("covered_points", f"{_TWO} SELECT id FROM v WHERE id IN (SELECT a FROM {_NEAR('v', 'h', 2)})")
def covered_points(p: DataFrame) -> DataFrame:
    return spatial.covered(*two_sources(p), 2.0).select("id")


@query("uncovered_points", f"{_TWO} SELECT id FROM v WHERE id NOT IN (SELECT a FROM {_NEAR('v', 'h', 2)})")
def uncovered_points(p: DataFrame) -> DataFrame:
    return spatial.covered(*two_sources(p), 2.0, yes=False).select("id")


@query("one_to_one_match")
def one_to_one_match(p: DataFrame) -> DataFrame:
    return spatial.match_one_to_one(*two_sources(p), 2.0)


_REACH = """un AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM pr), bi AS (SELECT u AS a, v AS b FROM un UNION SELECT v, u FROM un),
rc(node, label) USING KEY (node) AS (SELECT a, a FROM (SELECT DISTINCT a FROM bi) UNION (SELECT bi.b, min(rc.label) FROM rc JOIN bi ON bi.a = rc.node JOIN recurring.rc AS o ON o.node = bi.b WHERE rc.label < o.label GROUP BY bi.b))"""


@query("network_components", f"{_PRUNED}, {_REACH} SELECT label AS component, count(*) AS nodes FROM rc GROUP BY label")
def network_components(p: DataFrame) -> DataFrame:
    return evaluation.components(network.prune_weak(edge_table(p), 2, 0.5))


@query(
    "graph_metrics",
    f"""{_PRUNED}, {_REACH}, dg AS (SELECT a, count(*) AS d FROM bi GROUP BY a), cs AS (SELECT label, count(*) AS n FROM rc GROUP BY label)
SELECT (SELECT count(*) FROM un) AS edges, (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM dg WHERE d = 1) AS dead_ends, (SELECT count(*) FROM dg WHERE d >= 3) AS junctions, (SELECT count(*) FROM cs) AS components, (SELECT max(n) FROM cs) AS largest""",
)
def graph_metrics(p: DataFrame) -> DataFrame:
    return evaluation.graph_metrics(network.prune_weak(edge_table(p), 2, 0.5))


@query("validation_report", """c AS (SELECT count(*) AS total, count(*) FILTER (NOT (x BETWEEN -0.01 AND 1200.01 AND y BETWEEN -0.01 AND 1200.01)) AS b, count(*) FILTER (x IS NULL OR y IS NULL) AS p, count(*) FILTER (speed IS NULL) AS s, count(*) FILTER (NOT speed BETWEEN 0 AND 250) AS r, count(*) FILTER (source NOT IN ('VPD', 'HPD')) AS o FROM pts),
u AS (SELECT 'bounding_box' AS "check", b AS bad, total, 'WARN' AS lv FROM c UNION ALL SELECT 'missing_position', p, total, 'FAIL' FROM c UNION ALL SELECT 'missing_speed', s, total, 'WARN' FROM c UNION ALL SELECT 'speed_range', r, total, 'WARN' FROM c UNION ALL SELECT 'source', o, total, 'FAIL' FROM c)
SELECT "check", bad, total, CASE WHEN bad = 0 THEN 'PASS' ELSE lv END AS status FROM u""")
def validation_report(p: DataFrame) -> DataFrame:
    return evaluation.validation_report(p, (0.0, 0.0, 1200.0, 1200.0))


@query("heading_modality")
def heading_modality(p: DataFrame) -> DataFrame:
    return evaluation.heading_modality(windows.forward_headings(p).where("heading IS NOT NULL"))


@query("preprocessed_traces")
def preprocessed_traces(p: DataFrame) -> DataFrame:
    return windows.preprocess(traces.lines(p)).select("trace_id", "segment_part", F.size("line").alias("points"), r6(g.line_length("line"), "length"))


@query("line_wkt")
def line_wkt(p: DataFrame) -> DataFrame:
    return traces.lines(p).select("trace_id", g.to_wkt("line", 3).alias("wkt"))


@query("incremental_clusters")
def incremental_clusters(p: DataFrame) -> DataFrame:
    c = kernels.cluster_points(windows.forward_headings(p))
    return p.select("event_id", "x", "y").join(c, "event_id").groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg("x"), "x"), r6(F.avg("y"), "y"))


@query("duplicate_carriageways")
def duplicate_carriageways(p: DataFrame) -> DataFrame:
    return cleaning.duplicate_pairs(traces.lines(p), 40.0).select("a", "b", r6("hausdorff"))


@query("deduplicated_lines")
def deduplicated_lines(p: DataFrame) -> DataFrame:
    lines = traces.lines(p)
    kept = cleaning.keep_longest(lines, cleaning.duplicate_pairs(lines, 40.0))
    return kept.select("trace_id", "grp", r6(g.line_length("line"), "length"))


#: Segments in cells of 30 by their boxes; where two of different lines meet, ends of lines left out, equal places once.
_MEET = """sg AS (SELECT trace_id AS id, pos, pos = 1 AS fi, pos = max(pos) OVER (PARTITION BY trace_id) AS la, px AS x1, py AS y1, x AS x2, y AS y2 FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pts WINDOW w AS (PARTITION BY trace_id ORDER BY pos)) WHERE px IS NOT NULL AND (px <> x OR py <> y)),
ce AS (SELECT *, unnest(range(CAST(floor(least(y1, y2) / 30) AS BIGINT), CAST(floor(greatest(y1, y2) / 30) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(floor(least(x1, x2) / 30) AS BIGINT), CAST(floor(greatest(x1, x2) / 30) AS BIGINT) + 1)) AS cx FROM sg)),
pq AS (SELECT DISTINCT a.id AS a, b.id AS b, a.fi AS afi, a.la AS ala, b.fi AS bfi, b.la AS bla, a.x1 AS ax, a.y1 AS ay, a.x2 - a.x1 AS adx, a.y2 - a.y1 AS ady, b.x2 - b.x1 AS bdx, b.y2 - b.y1 AS bdy, b.x1 - a.x1 AS ox, b.y1 - a.y1 AS oy FROM ce a JOIN ce b ON a.cx = b.cx AND a.cy = b.cy AND a.id < b.id),
tu AS (SELECT *, (ox * bdy - oy * bdx) / (adx * bdy - ady * bdx) AS t, (ox * ady - oy * adx) / (adx * bdy - ady * bdx) AS u FROM pq WHERE adx * bdy - ady * bdx <> 0),
cr AS (SELECT a, b, min(ax + t * adx) AS x, min(ay + t * ady) AS y FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AND NOT (afi AND t = 0 OR ala AND t = 1 OR bfi AND u = 0 OR bla AND u = 1) GROUP BY a, b, round(ax + t * adx, 6), round(ay + t * ady, 6))"""


@query("line_crossings", f"{_MEET} SELECT a, b, round(x + 1e-7, 4) AS x, round(y + 1e-7, 4) AS y FROM cr")
def line_crossings(p: DataFrame) -> DataFrame:
    """Crossings of whole lines, segment by segment; a little is added so that halves round alike in both engines."""
    return cleaning.line_crossings(traces.lines(p)).select("a", "b", *(g.half_away(F.col(c) + 1e-7, 4).alias(c) for c in "xy"))


@query("junctions", f"{_MEET} SELECT CAST(floor((x + 15) / 30) AS BIGINT) AS cx, CAST(floor((y + 15) / 30) AS BIGINT) AS cy, round(avg(x), 3) AS x, round(avg(y), 3) AS y, count(*) AS crossings FROM cr GROUP BY 1, 2")
def junctions(p: DataFrame) -> DataFrame:
    j = cleaning.junctions(traces.lines(p))
    return j.select("cx", "cy", g.half_away("x", 3).alias("x"), g.half_away("y", 3).alias("y"), "crossings")


@query("simplified_lines")
def simplified_lines(p: DataFrame) -> DataFrame:
    s = traces.lines(p).withColumn("line", kernels.simplify_column(F.col("line"), 4.0))
    return s.select("trace_id", F.size("line").alias("points"), r6(g.line_length("line"), "length"))


_AROUND = "nb AS (SELECT trace_id, pos, x, y, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM pts WINDOW w AS (PARTITION BY trace_id ORDER BY pos))"


@query(
    "point_curvature",
    f"""{_AROUND}, sd AS (SELECT *, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS a, sqrt(pow(bx - x, 2) + pow(by_ - y, 2)) AS b, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS c, abs((x - ax) * (by_ - ay) - (bx - ax) * (y - ay)) / 2 AS area FROM nb WHERE ax IS NOT NULL AND bx IS NOT NULL)
SELECT trace_id, pos, round(CASE WHEN least(a, b, c) < 0.1 THEN 0 ELSE 4 * area / (a * b * c) END, 5) AS curvature FROM sd""",
)
def point_curvature(p: DataFrame) -> DataFrame:
    w = windows.by_trace()
    d = p.select("trace_id", "pos", "x", "y", *(f(c).over(w).alias(n + c) for c in ("x", "y") for f, n in ((F.lag, "a"), (F.lead, "b")))).where("ax IS NOT NULL AND bx IS NOT NULL")
    return d.select("trace_id", "pos", F.round(g.menger("ax", "ay", "x", "y", "bx", "by"), 5).alias("curvature"))


@query("fast_traces", "SELECT trace_id, count(*) AS n, round(avg(speed), 6) AS avg_speed, round(quantile_cont(speed, 0.5), 6) AS median_speed, min(second) AS time_start, max(second) AS time_end FROM pts GROUP BY trace_id HAVING avg(speed) >= 5 AND count(*) >= 2".join(["one AS (SELECT 1) ", ""]))
def fast_traces(p: DataFrame) -> DataFrame:
    a = p.groupBy("trace_id").agg(F.count("*").alias("n"), F.avg("speed").alias("s"), F.median("speed").alias("m"), F.min("second").alias("time_start"), F.max("second").alias("time_end"))
    return a.where("s >= 5 AND n >= 2").select("trace_id", "n", r6("s", "avg_speed"), r6("m", "median_speed"), "time_start", "time_end")


@query("hour_mode_by_road", "h AS (SELECT road, hour, count(*) AS n FROM pts GROUP BY ALL) SELECT road, arg_max(hour, (n, -hour)) AS hour, max(n) AS n FROM h GROUP BY road")
def hour_mode_by_road(p: DataFrame) -> DataFrame:
    h = p.groupBy("road", "hour").agg(F.count("*").alias("n"))
    return h.groupBy("road").agg(F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("hour"), F.max("n").alias("n"))


@query("longest_edges", f"{_EDGES} SELECT u, v, support, round(length / support, 6) AS mean_step FROM ed ORDER BY support, length / support DESC, u, v LIMIT 50")
def longest_edges(p: DataFrame) -> DataFrame:
    """Top-k report: candidates of transitive pruning, weakest first, then longest."""
    e = edge_table(p).withColumn("m", F.col("length") / F.col("support"))
    return e.orderBy("support", F.desc("m"), "u", "v").limit(50).select("u", "v", "support", r6("m", "mean_step"))


@query("two_way_links", f"{_EDGES} SELECT a.u, a.v, a.support, b.support AS reverse_support FROM ed a JOIN ed b ON a.u = b.v AND a.v = b.u WHERE a.u < a.v")
def two_way_links(p: DataFrame) -> DataFrame:
    return network.with_reverse(edge_table(p)).where("reverse_support > 0 AND u < v").select("u", "v", "support", "reverse_support")


@query("every_fifth_point", "SELECT trace_id, pos, round(x, 6) AS x, round(y, 6) AS y FROM pts WHERE pos % 5 = 0".join(["one AS (SELECT 1) ", ""]))
def every_fifth_point(p: DataFrame) -> DataFrame:
    """Sampling operator: stride along each trace."""
    return p.where("pos % 5 = 0").select("trace_id", "pos", r6("x"), r6("y"))


@query(
    "direction_sectors",
    f"""{_STEP}, h AS (SELECT CAST(floor(({_BEARING("x - px", "y - py")} + 22.5) / 45) AS BIGINT) % 8 AS k, {_BEARING("x - px", "y - py")} AS b, step FROM st WHERE step > 0)
SELECT ['N','NE','E','SE','S','SW','W','NW'][k + 1] AS direction, count(*) AS n, round(sum(step), 3) AS length, count(*) FILTER (b >= 315 OR b < 45 OR (b >= 135 AND b < 225)) AS along_ns FROM h GROUP BY k""",
)
def direction_sectors(p: DataFrame) -> DataFrame:
    d = windows.steps(p).where("step > 0").withColumn("b", g.bearing("px", "py", "x", "y"))
    return d.groupBy(g.compass("b").alias("direction")).agg(F.count("*").alias("n"), F.round(F.sum("step"), 3).alias("length"), F.count_if(g.axis_name("b") == "N_S").alias("along_ns"))


from roadloom.plans import network_queries  # noqa: E402, F401  registers the queries of whole networks
