"""Centerlines: paths through the road graph, their statistics and their shape."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import lines as ln
from roadloom.operators.graph import connected_components
from roadloom.operators.network import degrees


def _undirected(e: DataFrame) -> DataFrame:
    return e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def _walk(links: list[tuple[int, int]]) -> list[int]:
    """Nodes of a chain or ring of links in order, from the smaller end, or from the smallest node towards its smaller neighbour."""
    around = defaultdict(list)
    for a, b in links:
        around[a].append(b)
        around[b].append(a)
    ends = sorted(n for n, x in around.items() if len(x) == 1)
    at, before = (ends or sorted(around))[0], None
    out = [at]
    for _ in links:
        rest = sorted(n for n in around[at] if n != before) or around[at]
        at, before = rest[0], at
        out.append(at)
    return out


def chains(e: DataFrame) -> DataFrame:
    """``(path, node_path)``: maximal paths whose inner nodes have two neighbours, and rings; every undirected edge is in one.

    Edges that meet at such a node are linked and components of edges are the paths; a path is one row of the
    result, and only then are its edges put in order, one path at a time.
    """
    u = _undirected(e)
    ident = u.withColumn("edge", F.xxhash64("u", "v"))
    inner = degrees(u).where("degree = 2").select("node")
    at = ident.select("edge", F.explode(F.array("u", "v")).alias("node")).join(inner, "node", "left_semi")
    links = at.groupBy("node").agg(F.min("edge").alias("src"), F.max("edge").alias("dst")).where("src <> dst")
    named = ident.join(connected_components(links).withColumnsRenamed({"id": "edge", "component": "path"}), "edge", "left").withColumn("path", F.coalesce("path", "edge"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [pdf.path.iloc[0]], "node_path": [_walk(list(zip(pdf.u, pdf.v, strict=True)))]})

    return named.select("path", "u", "v").groupBy("path").applyInPandas(order, "path long, node_path array<long>")


def greedy_paths(e: DataFrame) -> DataFrame:
    """``(path, node_path)``: paths grown along edges of most support, strongest start first, no node twice in a path, each edge in one.

    Greedy choices depend on each other within a connected component, so a component is one task.
    """
    parts = connected_components(_undirected(e), "u", "v")
    d = e.join(parts.withColumnsRenamed({"id": "u", "component": "comp"}), "u")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["support", "u", "v"], ascending=[False, True, True])
        free = dict.fromkeys(zip(pdf.u, pdf.v, strict=True))
        out_of, into = defaultdict(list), defaultdict(list)
        for u, v in free:
            out_of[u].append(v)
            into[v].append(u)
        paths = []
        for start in list(free):
            if start not in free:
                continue
            del free[start]
            path, seen = list(start), set(start)
            while (nxt := next((n for n in out_of[path[-1]] if n not in seen and (path[-1], n) in free), None)) is not None:
                del free[path[-1], nxt]
                path.append(nxt)
                seen.add(nxt)
            while (nxt := next((n for n in into[path[0]] if n not in seen and (n, path[0]) in free), None)) is not None:
                del free[nxt, path[0]]
                path.insert(0, nxt)
                seen.add(nxt)
            paths.append(path)
        return pd.DataFrame({"node_path": paths})

    found = d.select("comp", "u", "v", "support").groupBy("comp").applyInPandas(grow, "node_path array<long>")
    return found.select(F.xxhash64("node_path").alias("path"), "node_path")


def path_edges(paths: DataFrame) -> DataFrame:
    """``(path, k, a, b)``: the steps of every path."""
    return paths.select("path", "node_path", F.posexplode(F.expr("slice(node_path, 1, size(node_path) - 1)")).alias("k", "a")).select("path", "k", "a", F.expr("node_path[k + 1]").alias("b"))


def path_statistics(paths: DataFrame, e: DataFrame) -> DataFrame:
    """Per path the support of its edges in both directions, means weighted by support, and the direction of travel.

    ``B`` where both directions have support, else ``T`` along the path and ``F`` against it.
    """
    s = path_edges(paths)
    both = s.join(e.withColumnsRenamed({"u": "a", "v": "b"}), ["a", "b"]).withColumn("forward", F.lit(True)).unionByName(s.join(e.withColumnsRenamed({"u": "b", "v": "a"}), ["a", "b"]).withColumn("forward", F.lit(False)))
    w = F.col("support")
    t = both.groupBy("path").agg(
        F.sum(w).alias("support"),
        F.sum(F.when(F.col("forward"), w).otherwise(0)).alias("fw"),
        F.sum(F.when(~F.col("forward"), w).otherwise(0)).alias("rv"),
        F.sum("vpd_support").alias("vpd_support"),
        F.sum("hpd_support").alias("hpd_support"),
        (F.sum(F.col("mean_speed") * w) / F.sum(w)).alias("mean_speed"),
        (F.sum(F.col("heading_consistency") * w) / F.sum(w)).alias("heading_consistency"),
    )
    return t.withColumn("dir_travel", F.when((F.col("fw") > 0) & (F.col("rv") > 0), "B").when(F.col("fw") >= F.col("rv"), "T").otherwise("F"))


def path_lines(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(path, u, v, line, length, ends_apart)``: the paths as lines through their nodes (``node, x, y``)."""
    at = paths.select("path", F.posexplode("node_path").alias("k", "node")).join(nodes.select("node", "x", "y"), "node")
    d = at.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "node", "x", "y"))).alias("p"))
    d = d.select("path", F.expr("p[0].node").alias("u"), F.expr("element_at(p, -1).node").alias("v"), F.expr("transform(p, q -> named_struct('x', q.x, 'y', q.y))").alias("line"))
    return d.withColumn("length", g.line_length("line")).withColumn("ends_apart", F.expr("hypot(element_at(line, -1).x - line[0].x, element_at(line, -1).y - line[0].y)"))


def centerlines(e: DataFrame, nodes: DataFrame, least: float = 6.0, greedy: bool = False) -> DataFrame:
    """Stitched paths with statistics, smoothed but at their turns; those shorter than ``least`` are dropped."""
    paths = greedy_paths(e) if greedy else chains(e)
    d = path_lines(paths, nodes).join(path_statistics(paths, e), "path").withColumn("weighted_support", F.col("support").cast("double"))
    d = ln.per_line(d, lambda xy: [(ln.smooth_keeping_turns(xy, 2, 35.0, 0.2),)], f"line {ln.LINE}")
    return d.withColumn("length", g.line_length("line")).where(F.col("length") >= least)


def shaped_edges(edges: DataFrame, points: DataFrame, least: float = 25.0, deviation: float = 2.0) -> DataFrame:
    """``(u, v, line)``: straight edges bent through the medians of the points of their traces.

    ``edges`` has the places of both nodes, ``points`` (u, v, x, y) those of the edge's traces. Points between 5 and 95
    percent of an edge count; an edge of ``least`` or more, with two points or more and one that far off, gets one inner
    vertex for each of 2 to 10 bins, the median of the bin's points or the straight place where there are none.
    """
    d = edges.withColumn("len", g.distance("x1", "y1", "x2", "y2")).withColumn("bins", F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("len") / 15))).cast("int"))
    p = points.join(d.where(F.col("len") >= least), ["u", "v"]).withColumn("t", F.expr("((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (len * len)")).where("t BETWEEN 0.05 AND 0.95")
    p = p.withColumn("off", F.expr("abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / len")).withColumn("bin", F.least(F.col("bins") - 1, F.floor(F.col("t") * F.col("bins"))).cast("int"))
    good = p.groupBy("u", "v").agg(F.count("*").alias("n"), F.max("off").alias("far")).where((F.col("n") >= 2) & (F.col("far") >= deviation)).select("u", "v")
    bins = p.join(good, ["u", "v"], "left_semi").groupBy("u", "v", "bin").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    shape = bins.groupBy("u", "v").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(F.col("mx").alias("x"), F.col("my").alias("y"))))).alias("m"))
    plain = "named_struct('x', x1 + (x2 - x1) * (b + 0.5D) / bins, 'y', y1 + (y2 - y1) * (b + 0.5D) / bins)"
    inner = F.expr(f"CASE WHEN m IS NULL THEN array() ELSE transform(sequence(0, bins - 1), b -> coalesce(m[b], {plain})) END").cast(ln.LINE)
    ends = [F.array(F.struct(F.col("x" + k).alias("x"), F.col("y" + k).alias("y"))) for k in "12"]
    return d.join(shape, ["u", "v"], "left").select("u", "v", F.concat(ends[0], inner, ends[1]).alias("line"))


def levels(points: DataFrame, key: str, z: str = "z", gap: float = 3.0) -> DataFrame:
    """``points`` plus ``level``: groups of heights per key, a new one at every gap over ``gap``; points without a height join the largest."""
    w = Window.partitionBy(key).orderBy(z)
    known = points.where(F.col(z).isNotNull()).withColumn("_new", F.coalesce((F.col(z) - F.lag(z).over(w) > gap).cast("long"), F.lit(0)))
    known = known.withColumn("level", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    largest = known.groupBy(key, "level").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("level"))
    return known.unionByName(points.where(F.col(z).isNull()).join(largest, key, "left").withColumn("level", F.coalesce("level", F.lit(0))))
