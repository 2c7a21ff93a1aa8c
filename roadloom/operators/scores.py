"""Scores of a network of lines against a reference map (both ``id, line``), by length, by topology and by shape."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import carriageways, evaluation, overlay, spatial, topology
from roadloom.operators import lines as ln
from roadloom.operators.graph import connected_components
from roadloom.operators.kernels import hausdorff_column
from roadloom.operators.network import degrees
from roadloom.session import cut


def _ratio(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def _f1(p: str, r: str) -> Column:
    return _ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables as one row."""
    keyed = [r.withColumn("_k", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def with_lengths(net: DataFrame) -> DataFrame:
    return net.select("id", "line", g.line_length("line").alias("length"))


def chunked(net: DataFrame, most: float = 20.0) -> DataFrame:
    """Lines as runs of whole segments that end with the one that reaches ``most``, with ids of their own."""
    d = ln.per_line(net.select("id", "line"), lambda xy: enumerate(ln.chunk_by_length(xy, most)), f"chunk int, line {ln.LINE}")
    return d.select(F.xxhash64("id", "chunk").alias("id"), F.col("id").alias("of"), "chunk", "line")


def _matched(a: DataFrame, b: DataFrame, r: float, name: str) -> DataFrame:
    """One row: the share of the length of lines of ``a`` that ``b`` comes within ``r`` of anywhere."""
    d = with_lengths(a).join(overlay.touched(a, b, r).withColumn("hit", F.lit(1)), "id", "left")
    return d.agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias(name + "_length"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("length"))), F.lit(0.0)).alias(name + "_matched"))


def touching_score(net: DataFrame, truth: DataFrame, r: float = 15.0, chunk: float | None = 20.0) -> DataFrame:
    """Precision and recall in percent by whole chunks, or by whole lines without ``chunk``: one counts if any part of it is within ``r``."""
    a, b = (x if chunk is None else cut(chunked(x, chunk)) for x in (net, truth))
    d = side_by_side(_matched(a, truth if chunk is None else b, r, "net"), _matched(b, net if chunk is None else a, r, "truth"))
    d = d.withColumn("precision", F.round(100 * _ratio("net_matched", "net_length"), 2)).withColumn("recall", F.round(100 * _ratio("truth_matched", "truth_length"), 2))
    return d.withColumn("f1", F.round(_f1("precision", "recall"), 2))


def buffer_score(net: DataFrame, truth: DataFrame, r: float = 15.0) -> DataFrame:
    """Precision, recall and F1 by clipped length: what of each line lies within ``r`` of the other network, overlaps counted once."""
    side = lambda a, b, n: overlay.length_within(a, b, r).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias(n + "_length"), F.coalesce(F.sum("inside_length"), F.lit(0.0)).alias(n + "_inside"))
    d = side_by_side(side(net, truth, "net"), side(truth, net, "truth")).withColumn("precision", _ratio("net_inside", "net_length")).withColumn("recall", _ratio("truth_inside", "truth_length"))
    return d.withColumn("f1", _f1("precision", "recall")).withColumn("length_ratio", _ratio("net_length", "truth_length"))


def redundancy(net: DataFrame, r: float = 5.0) -> DataFrame:
    """One row: the length that lies within ``r`` of another line of the network, halved, and its share of all."""
    d = overlay.covered_intervals(net, net, r, others=True).select("total", F.expr("aggregate(inside, 0D, (s, x) -> s + x.hi - x.lo)").alias("inside"))
    return d.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("length"), (F.coalesce(F.sum("inside"), F.lit(0.0)) / 2).alias("redundant")).withColumn("share", _ratio("redundant", "length"))


def overlap_statistics(net: DataFrame, other: DataFrame, r: float = 15.0) -> DataFrame:
    """One row: kilometres of ``net`` covered by ``other``, their percentage, and what ``other`` may add."""
    a, b = overlay.length_within(net, other, r), overlay.length_within(other, net, r)
    one = a.agg((F.sum("inside_length") / 1000).alias("covered_km"), (F.sum("total") / 1000).alias("total_km"))
    two = b.agg((F.sum(F.col("total") - F.col("inside_length")) / 1000).alias("new_km"))
    return side_by_side(one, two).withColumn("covered_pct", 100 * _ratio("covered_km", "total_km"))


# ---- points along lines


def samples(net: DataFrame, step: float = 10.0) -> DataFrame:
    """``(id, of, x, y)``: max(1, length div step) equal parts of every line, their bounds as points."""

    def kernel(xy):
        n = max(int(ln.length(xy) // step), 1)
        for k, p in enumerate(ln.resample(xy, n + 1)):
            yield k, float(p[0]), float(p[1])

    d = ln.per_line(net.select("id", "line"), kernel, "k int, x double, y double")
    return d.select(F.xxhash64("id", "k").alias("id"), F.col("id").alias("of"), "x", "y")


def distance_statistics(a: DataFrame, b: DataFrame, r: float = 25.0) -> DataFrame:
    """One row: count, mean, median, 90 and 95 percent of the distances of points of ``a`` to the nearest of ``b``, and their root mean square."""
    d = spatial.nearest_any(a, b, r)
    return side_by_side(evaluation.distance_summary(d), d.agg(F.sqrt(F.avg(F.col("dist") * F.col("dist"))).alias("rmse")))


def matched_points(a: DataFrame, b: DataFrame, radii: Iterable[float] = (8.0, 15.0)) -> DataFrame:
    """Per radius precision, recall and F1 of one-to-one matched points, nearest pairs first."""
    na, nb = (x.agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb")))
    rows = [side_by_side(spatial.match_one_to_one(a, b, r).agg(F.count("*").alias("matched")), na, nb).withColumn("radius", F.lit(float(r))) for r in clean_radii(radii)]
    d = reduce(DataFrame.unionByName, rows).withColumn("precision", _ratio("matched", "na")).withColumn("recall", _ratio("matched", "nb"))
    return d.withColumn("f1", _f1("precision", "recall")).select("radius", "matched", "precision", "recall", "f1")


def clean_radii(radii: Iterable[float]) -> list[float]:
    """Finite positive radii, each once, in order; 8 and 15 if there are none."""
    return sorted({float(r) for r in radii if np.isfinite(r) and r > 0}) or [8.0, 15.0]


def away_from(points: DataFrame, holes: DataFrame, r: float) -> DataFrame:
    return spatial.covered(points, holes, r, yes=False)


# ---- graphs


def graph_nodes(net: DataFrame, grid: float = 1.0) -> DataFrame:
    """``(node, x, y, degree)`` of the rounded graph."""
    e = topology.rounded_graph(net, grid)
    d = degrees(e.select(F.col("u"), F.col("v")))
    return d.select(F.xxhash64("node").alias("node"), (F.col("node.x") * grid).alias("x"), (F.col("node.y") * grid).alias("y"), "degree")


def topology_metrics(net: DataFrame, grid: float = 1.0) -> DataFrame:
    """One row: nodes, edges, components, the largest, dead ends, joints and junctions."""
    e = cut(topology.rounded_graph(net, grid).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")))
    return evaluation.graph_metrics(e)


def degree_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Jensen-Shannon divergence of two degree distributions, 0 to 1, and 1 less it."""
    total = lambda d: d.agg(F.sum("n")).first()[0] or 1
    ha, hb = (x.groupBy("degree").agg(F.count("*").alias("n")) for x in (a, b))
    d = ha.withColumnRenamed("n", "p").join(hb.withColumnRenamed("n", "q"), "degree", "full_outer").select((F.coalesce("p", F.lit(0)) / float(total(ha))).alias("p"), (F.coalesce("q", F.lit(0)) / float(total(hb))).alias("q"))
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(0.0)
    js = F.coalesce(F.sum(0.5 * half("p") + 0.5 * half("q")) / F.log(F.lit(2.0)), F.lit(0.0))
    return d.agg(js.alias("js")).withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("js")))


def relative_edit_distance(net: DataFrame, truth: DataFrame, grid: float = 1.0) -> DataFrame:
    """One row: differences in numbers of nodes and edges over those of the truth."""
    count = lambda x, n: topology_metrics(x, grid).select(F.col("nodes").alias(n + "_nodes"), F.col("edges").alias(n + "_edges"))
    d = side_by_side(count(net, "net"), count(truth, "truth"))
    return d.withColumn("ged", _ratio(F.abs(F.col("net_nodes") - F.col("truth_nodes")) + F.abs(F.col("net_edges") - F.col("truth_edges")), F.col("truth_nodes") + F.col("truth_edges")))


def shortest_paths(e: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """``(source, node, dist)``: least lengths from each source (``node``) over undirected edges ``u, v, length``, by rounds of relaxing.

    Only places that got nearer in a round go on in the next; raises if ``rounds`` are not enough.
    """
    hop = cut(e.select("u", "v", "length").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "length")).groupBy("u", "v").agg(F.min("length").alias("length")))
    best = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")))
    fresh = best
    for _ in range(rounds):
        step = fresh.join(hop, fresh.node == hop.u).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("length")).alias("new"))
        both = cut(best.join(step, ["source", "node"], "full_outer"))
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        fresh = both.where(better).select("source", "node", F.col("new").alias("dist"))
        best = both.select("source", "node", F.least("dist", "new").alias("dist"))
        if fresh.isEmpty():
            return best
    raise RuntimeError(f"paths did not settle in {rounds} rounds")


def path_similarity(net: DataFrame, truth: DataFrame, n: int = 20, r: float = 15.0, grid: float = 1.0, seed: int = 1) -> DataFrame:
    """One row: 1 less the mean relative difference of least path lengths between seeded pairs of the truth's nodes (a sampling metric).

    Nodes answer to the nearest one within ``r``; a pair without a node or a path in the network counts 1.
    """
    key = lambda e: e.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"), "length")
    et, en = (cut(key(topology.rounded_graph(x, grid))) for x in (truth, net))
    nt, nn = cut(graph_nodes(truth, grid)), cut(graph_nodes(net, grid))
    start = nt.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n).select("node")
    want = shortest_paths(et, start).where("source <> node")
    want = cut(want.orderBy(F.xxhash64("source", "node", F.lit(seed)), "source", "node").limit(n * n))
    to = spatial.nearest(nt.select(F.col("node").alias("id"), "x", "y"), nn.select(F.col("node").alias("id"), "x", "y"), r).select(F.col("a").alias("t"), F.col("b").alias("m"))
    d = want.join(to.withColumnsRenamed({"t": "source", "m": "ms"}), "source", "left").join(to.withColumnsRenamed({"t": "node", "m": "mn"}), "node", "left")
    got = shortest_paths(en, d.where("ms IS NOT NULL").select(F.col("ms").alias("node")).distinct()).withColumnsRenamed({"source": "ms", "node": "mn", "dist": "found"})
    d = d.join(got, ["ms", "mn"], "left").withColumn("loss", F.coalesce(F.least(F.lit(1.0), F.abs(F.col("dist") - F.col("found")) / F.col("dist")), F.lit(1.0)))
    return d.agg(F.count("*").alias("pairs"), F.coalesce(1 - F.avg("loss"), F.lit(0.0)).alias("apls"))


# ---- shape


def link_distances(truth: DataFrame, net: DataFrame, r: float = 30.0, step: float = 5.0) -> DataFrame:
    """``(id, hausdorff)``: of every link the greatest distance of its points from the lines near it; null where none is within ``r``."""
    d = samples(truth, step)
    n = overlay.nearest_on_lines(d.select(F.col("id").alias("pid"), "of", "x", "y"), net, r).select("pid", "dist")
    near = overlay.touched(truth, net, r).withColumn("near", F.lit(1))
    out = d.join(n, d.id == n.pid, "left").groupBy(F.col("of").alias("id")).agg(F.max(F.coalesce("dist", F.lit(float(r)))).alias("hausdorff"))
    return out.join(near, "id", "left").select("id", F.when(F.col("near") == 1, F.col("hausdorff")).alias("hausdorff"))


def hausdorff_summary(net: DataFrame, truth: DataFrame, r: float = 30.0) -> DataFrame:
    """One row: how near the best of the close lines of the truth comes to each line of the network."""
    p = overlay.within(net, truth, r).select("a", "b").join(net.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(truth.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    best = p.select("a", hausdorff_column(F.col("la"), F.col("lb")).alias("dist")).groupBy("a").agg(F.min("dist").alias("dist"))
    return evaluation.distance_summary(best)


def smoothness(net: DataFrame) -> DataFrame:
    """One row: mean and median of 180 less the turn over all inner vertices; a straight line scores 180."""
    d = ln.per_line(net.select("id", "line"), lambda xy: [(180.0 - float(t),) for t in ln.turns(xy)] or [(180.0,)], "score double")
    return d.agg(F.avg("score").alias("mean"), F.median("score").alias("median"))


def curvature_smoothness(net: DataFrame) -> DataFrame:
    """One row: how evenly curvature changes, 1 / (1 + mean spread of its differences), and mean of 1 / (1 + its maximum)."""

    def kernel(xy):
        k = ln.gradient_curvature(xy)
        yield float(np.std(np.diff(k))) if len(k) > 1 else 0.0, 1 / (1 + float(k.max()))

    d = ln.per_line(net.select("id", "line"), kernel, "spread double, calm double")
    return d.agg((1 / (1 + F.avg("spread"))).alias("continuity"), F.avg("calm").alias("smoothness"))


# ---- reports


def recovery_by_class(truth: DataFrame, net: DataFrame, key: str = "func_class", r: float = 15.0) -> DataFrame:
    """Per class of the map its length, the length within ``r`` of the network, and the share."""
    d = overlay.length_within(truth, net, r).join(truth.select("id", key), "id").groupBy(key).agg(F.sum("total").alias("length"), F.sum("inside_length").alias("recovered"))
    return d.withColumn("recall", _ratio("recovered", "length"))


def uncovered_buckets(truth: DataFrame, net: DataFrame, r: float = 15.0, step: float = 10.0) -> DataFrame:
    """``(bucket, n)``: samples of the map farther than ``r`` from the network, by how far the nearest line is."""
    s = samples(truth, step).select(F.col("id").alias("pid"), "x", "y")
    d = s.select("pid").join(overlay.nearest_on_lines(s, net, 100.0).select("pid", "dist"), "pid", "left").where(F.col("dist").isNull() | (F.col("dist") > r))
    bucket = F.when(F.col("dist") < 25, "<25").when(F.col("dist") < 50, "<50").when(F.col("dist") < 100, "<100").otherwise(">100")
    return d.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def connectivity(net: DataFrame, r: float = 50.0) -> DataFrame:
    """``(gap, n)``: dead ends by the distance to the nearest end of another line, in classes to 5, 10, 15, 25, 50 and beyond."""
    from roadloom.operators.refine import keyed_ends

    e = cut(keyed_ends(net).select("eid", "id", "x", "y", "ex", "ey", "degree"))
    free = e.where("degree = 1")
    near = spatial.within(free.select(F.col("eid").alias("id"), "x", "y"), e.select(F.col("eid").alias("id"), "x", "y"), r).where(F.expr("a DIV 2 <> b DIV 2")).groupBy("a").agg(F.min("dist").alias("dist"))
    d = free.join(near, free.eid == near.a, "left")
    gap = F.when(F.col("dist") < 5, "<5").when(F.col("dist") < 10, "5-10").when(F.col("dist") < 15, "10-15").when(F.col("dist") < 25, "15-25").when(F.col("dist") <= 50, "25-50").otherwise(">50")
    return d.groupBy(gap.alias("gap")).agg(F.count("*").alias("n"))


def step_losses(before: DataFrame, after: DataFrame, truth: DataFrame, r: float = 15.0) -> DataFrame:
    """One row: what a step removed, in kilometres, and how much of that lay on the map (lost) and off it (cleared)."""
    gone = before.join(after.select("id"), "id", "left_anti")
    d = overlay.length_within(gone.select("id", "line"), truth, r)
    return d.agg(F.count("*").alias("lines"), (F.coalesce(F.sum("total"), F.lit(0.0)) / 1000).alias("removed_km"), (F.coalesce(F.sum("inside_length"), F.lit(0.0)) / 1000).alias("lost_km"), (F.coalesce(F.sum(F.col("total") - F.col("inside_length")), F.lit(0.0)) / 1000).alias("cleared_km"))


def by_source(net: DataFrame, truth: DataFrame, r: float = 15.0) -> DataFrame:
    """Per source of lines their number, length and precision."""
    d = overlay.length_within(net.select("id", "line"), truth, r).join(net.select("id", "source"), "id").groupBy("source").agg(F.count("*").alias("lines"), F.sum("total").alias("length"), F.sum("inside_length").alias("inside"))
    return d.withColumn("precision", _ratio("inside", "length"))


def evaluate(net: DataFrame, truth: DataFrame, r: float = 15.0, step: float = 10.0, radii: Iterable[float] = (8.0, 15.0)) -> DataFrame:
    """One nested row with everything: length, distances, topology, matched points with and without intersections, shape."""
    net, truth = cut(net.select("id", "line")), cut(truth.select("id", "line"))
    a, b = cut(samples(net, step)), cut(samples(truth, step))
    na, nb = cut(graph_nodes(net)), cut(graph_nodes(truth))
    crossings = lambda n: n.where("degree >= 3").select(F.col("node").alias("id"), "x", "y")
    r0 = clean_radii(radii)[0]
    one = lambda d, name: d.select(F.struct("*").alias(name))
    many = lambda d, name: d.agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias(name))
    return side_by_side(
        one(touching_score(net, truth, r), "chunks"),
        one(touching_score(net, truth, r, None), "whole_lines"),
        one(buffer_score(net, truth, r), "length"),
        one(distance_statistics(a, b), "net_to_truth"),
        one(distance_statistics(b, a), "truth_to_net"),
        one(degree_divergence(na, nb), "degrees"),
        one(distance_statistics(crossings(na), crossings(nb)), "intersections"),
        many(matched_points(a, b, radii), "topo"),
        many(matched_points(away_from(a, crossings(na), r0), away_from(b, crossings(nb), r0), radii), "i_topo"),
        one(topology_metrics(net), "topology"),
        one(relative_edit_distance(net, truth), "edit_distance"),
        one(redundancy(net), "redundancy"),
        one(smoothness(net), "smoothness"),
        one(curvature_smoothness(net), "curvature"),
        one(hausdorff_summary(net, truth), "hausdorff"),
        one(carriageways.lane_widths(net), "lanes"),
    )


def report(metrics: DataFrame) -> DataFrame:
    """``(metric, value)``: the numbers of a nested row of metrics by dotted name, as text."""
    from roadloom.sources.sinks import flat

    f = flat(metrics)
    return f.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value")) for c in f.columns))))


def components_of(net: DataFrame, grid: float = 0.1) -> DataFrame:
    """``(component, nodes)`` of the lines' ends, joined where they agree to 0.1."""
    e = topology.rounded_graph(net, grid).select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    return connected_components(e, "u", "v").groupBy("component").agg(F.count("*").alias("nodes"))
