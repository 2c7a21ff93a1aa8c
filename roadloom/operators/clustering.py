"""Clustering of points, traces and parts of traces, and lines that stand for clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import courses, overlay, pairing, spatial
from roadloom.operators import lines as ln
from roadloom.operators.density import density_clusters
from roadloom.operators.graph import connected_components
from roadloom.operators.kernels import simplify
from roadloom.operators.topology import mean_line
from roadloom.session import cut, few, stored


def cluster_polylines(pts: DataFrame, eps: float = 15.0, least: int = 5, turn: float = 30.0, tolerance: float = 2.0, shortest: float = 10.0) -> DataFrame:
    """Density clusters of points with headings as lines: points in order of the first principal axis, in bins, simplified."""
    d = density_clusters(pts, eps, least, turn, keep=("x", "y"))
    s = d.groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.count("*").alias("support"))
    axis = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    p = d.join(few(s.withColumn("t", axis)), "cluster").withColumn("s", (F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t"))
    bins = p.groupBy("cluster", "support", F.floor(F.col("s") / eps).alias("bin")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    line = bins.groupBy("cluster", "support").agg(F.array_sort(F.collect_list(F.struct("bin", "x", "y"))).alias("p"))
    line = line.select(F.col("cluster").alias("id"), "support", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line")).where(F.size("line") >= 2)
    return ln.per_line(line, lambda xy: [(simplify(xy, tolerance),)], f"line {ln.LINE}").where(g.line_length("line") >= shortest)


def alike_lines(net: DataFrame, distance: float, degrees: float = 30.0, both_ways: bool = True) -> DataFrame:
    """``(a, b, hausdorff)``: lines of about one heading at most ``distance`` apart everywhere."""
    turn = (lambda d: np.minimum(d, 180 - d)) if both_ways else (lambda d: d)
    agree = lambda a, b, i, js: turn(ln.angle(b.h[js], a.h[i])) <= degrees
    return pairing.close_pairs(net, distance, accept=agree).withColumnRenamed("dist", "hausdorff")


def medoids(net: DataFrame, pairs: DataFrame, distance: str = "hausdorff") -> DataFrame:
    """One line for each component of pairs: the one with the least mean distance to those it is paired with; lines of none stand for themselves."""
    pairs = cut(pairs)
    groups = connected_components(pairs, "a", "b")
    each = pairs.select(F.explode(F.array("a", "b")).alias("id"), distance).groupBy("id").agg(F.avg(distance).alias("d"), F.count("*").alias("n"))
    best = groups.join(each, "id").groupBy("component").agg(F.min(F.struct(F.col("d"), (-F.col("n")).alias("k"), "id")).alias("m"), F.count("*").alias("members")).select("m.id", "members")
    alone = net.join(groups.select("id"), "id", "left_anti").withColumn("members", F.lit(1).cast("long"))
    return net.join(best, "id").unionByName(alone)


def trace_clusters(net: DataFrame, distance: float = 15.0) -> DataFrame:
    return medoids(net, alike_lines(net, distance))


def nearest_to_centroid(net: DataFrame, groups: DataFrame) -> DataFrame:
    """Of every group (``id, component``) the line whose middle of vertices is nearest to the mean of all of them."""
    m = ln.per_line(net.select("id", "line"), lambda xy: [tuple(xy.mean(axis=0).tolist())], "x double, y double").join(groups, "id")
    c = m.groupBy("component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    best = m.join(c, "component").groupBy("component").agg(F.min_by("id", F.struct(g.distance("x", "y", "cx", "cy"), F.col("id"))).alias("id"), F.count("*").alias("members"))
    return net.join(best, "id")


def greedy_cover(net: DataFrame, distance: float = 10.0) -> DataFrame:
    """Longest lines first, each kept unless it lies within ``distance`` of one kept already; settled within components of like lines."""
    pairs = cut(alike_lines(net, distance, 180.0))
    groups = connected_components(pairs, "a", "b")
    size = net.select(F.col("id"), g.line_length("line").alias("length"))
    d = groups.join(size, "id").join(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("o")), F.struct(F.col("b").alias("id"), F.col("a").alias("o")))).alias("x")).select("x.*").groupBy("id").agg(F.collect_list("o").alias("near")), "id")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: set[int] = set()
        for i, near in pdf.sort_values(["length", "id"], ascending=[False, True])[["id", "near"]].itertuples(index=False):
            if not kept.intersection(near):
                kept.add(i)
        return pd.DataFrame({"id": [i for i in pdf.id if i not in kept]}, dtype="int64")

    return net.join(d.groupBy("component").applyInPandas(settle, "id long"), "id", "left_anti")


def gap_lines(gaps: DataFrame, eps: float = 12.0, least: int = 2, sector: float = 30.0, shortest: float = 6.0, weighted: bool = True) -> DataFrame:
    """Gap pieces (``id, line``) clustered by middle and sector of heading; each cluster gives its medoid, support being its size times half
    and half the agreement of headings, or its size alone; noise and short lines go."""
    m = stored(ln.middles(gaps).drop("line"))
    m = m.withColumn("bin", F.floor(F.pmod(F.round("heading", 9), F.lit(180.0)) / sector))
    # pieces cut at the edge of a buffer run right along a border of sectors, hence the rounding; sectors are kept apart by shifting each far away
    shifted = m.select("id", (F.col("x") + F.col("bin") * 1e9).alias("x"), "y")
    # the lines themselves are fetched for the medoids only
    d = stored(m.join(density_clusters(shifted, eps, least), "id"))
    w = F.greatest(F.col("length"), F.lit(1e-12)) if weighted else F.lit(1.0)
    r = F.radians(2 * F.col("heading"))
    c = d.groupBy("cluster").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("cx"), (F.sum(F.col("y") * w) / F.sum(w)).alias("cy"), F.count("*").alias("n"), F.hypot(F.avg(F.sin(r)), F.avg(F.cos(r))).alias("agree"))
    best = d.join(c, "cluster").groupBy("cluster").agg(F.min_by(F.struct("id", "n", "agree", "length"), F.struct(g.distance("x", "y", "cx", "cy"), F.col("id"))).alias("m")).select("m.*")
    return best.join(gaps.select("id", "line"), "id").where(F.col("length") >= shortest).select("id", "line", (F.col("n") * (0.5 + 0.5 * F.col("agree")) if weighted else F.col("n").cast("double")).alias("support"))


# ---- parts of traces


def subtrajectories(traces: DataFrame, length: float = 65.0, step: float = 18.0, spacing: float = 5.0) -> DataFrame:
    """``(sid, id, win, line, x, y, heading, ...)``: windows of about ``length`` every ``step`` along resampled traces, a last one at the end; all of a trace."""
    size, hop = max(4, round(length / spacing)), max(2, round(step / spacing))

    def kernel(xy):
        even = ln.at_distance(xy, ln.step_points(xy, spacing))
        if len(even) < 4:
            return
        starts = list(range(0, max(1, len(even) - size + 1), hop))
        if starts[-1] + size < len(even):
            starts.append(len(even) - size)
        for k, s in enumerate(starts):
            part = even[s : s + size]
            yield k, part, *part.mean(axis=0).tolist(), float(ln.bearings(part[-1] - part[0]))

    return ln.per_line(traces, kernel, f"win int, line {ln.LINE}, x double, y double, heading double").withColumn("sid", F.xxhash64("id", "win"))


def subtrajectory_groups(subs: DataFrame, centre: float = 35.0, degrees: float = 30.0, most: float = 16.0, members: int = 3, support: float = 5.5, weight: str | None = None) -> DataFrame:
    """``(sid, component)`` of windows whose centres, headings (opposite ones apart) and courses agree; groups of enough members and weight."""
    groups = cut(courses.groups(subs, centre, degrees, most))
    w = F.sum(weight) if weight else F.count("*").cast("double")
    good = groups.join(subs.select("sid", *([weight] if weight else [])), "sid").groupBy("component").agg(F.count("*").alias("n"), w.alias("w")).where((F.col("n") >= members) & (F.col("w") >= support)).select("component")
    return groups.join(good, "component", "left_semi").select("sid", "component")


def representatives(subs: DataFrame, groups: DataFrame, weight: str | None = None, sample: int = 200) -> DataFrame:
    """``(id, line, support, members)``: of every group the weighted median line, smoothed; its turns stay."""
    d = subs.join(few(groups), "sid").withColumn("w", F.col(weight).cast("double") if weight else F.lit(1.0))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("sid")
        w = table.column("w").to_numpy()
        line = mean_line([p for chunk in table.column("line").chunks for p in ln.arrays_of(chunk)], w, 8, sample)
        line = ln.smooth_keeping_turns(line, 1, 35.0, 0.2)
        return pa.table({"id": table.column("component")[:1], "line": [[{"x": float(x), "y": float(y)} for x, y in line]], "support": [float(w.sum())], "members": [len(w)]})

    return d.select("component", "sid", "line", "w").groupBy("component").applyInArrow(run, f"id long, line {ln.LINE}, support double, members long")


def vertices(reps: DataFrame, turn: float = 35.0, crossing: float = 15.0, r: float = 12.0) -> DataFrame:
    """``(node, x, y, weight, members)``: ends, turns and crossings of representatives, gathered within ``r``."""

    def kernel(xy):
        for k in np.flatnonzero(ln.fixed_at_turns(xy, turn)):
            yield tuple(xy[k].tolist())

    own = ln.per_line(reps.select("id", "line", "support"), kernel, "x double, y double").select("x", "y", F.col("support").alias("w"))
    x = overlay.crossing_points(reps.select("id", "line")).join(reps.select(F.col("id").alias("a"), F.col("support").alias("sa"), g.start_end_heading("line").alias("ha")), "a").join(reps.select(F.col("id").alias("b"), F.col("support").alias("sb"), g.start_end_heading("line").alias("hb")), "b")
    x = x.where(g.axis_difference("ha", "hb") >= crossing).select("x", "y", (F.col("sa") + F.col("sb")).alias("w"))
    # equal ones are one point that counts as many times
    v = own.unionByName(x).groupBy("x", "y", "w").agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("x", "y", "w"))
    parts = connected_components(spatial.pairs(v, r), "a", "b")
    d = v.join(parts, "id", "left").withColumn("node", F.coalesce("component", "id"))
    w = F.col("w") * F.col("n")
    return d.groupBy("node").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"), F.sum(w).alias("weight"), F.sum("n").alias("members"))


def vertex_edges(reps: DataFrame, nodes: DataFrame, r: float = 14.0, dangling: float = 30.0, support: float = 8.0) -> DataFrame:
    """``(u, v, line, support, length)``: nodes that a representative passes, in its order, linked; the strongest line stands for a link, and
    short weak links with a free end go."""
    hit = overlay.nearest_on_lines(nodes.select(F.col("node").alias("pid"), "x", "y"), reps.select("id", "line"), r, k=1 << 30)
    seq = hit.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("pid").alias("node")))).alias("s")).where(F.size("s") >= 2).join(reps.select("id", "line", "support"), "id")

    def kernel(xy, s, w):
        for p, q in zip(s[:-1], s[1:], strict=True):
            if p["node"] != q["node"] and q["at"] > p["at"]:
                part = ln.substring(xy, p["at"], q["at"])
                yield (p["node"], q["node"], part, w) if p["node"] < q["node"] else (q["node"], p["node"], part[::-1], w)

    d = ln.per_line(seq.select("line", "s", "support"), kernel, f"u long, v long, line {ln.LINE}, support double", also=("s", "support"), drop=("s",))
    e = d.groupBy("u", "v").agg(F.max_by("line", F.struct("support", g.line_length("line"))).alias("line"), F.sum("support").alias("support")).withColumn("length", g.line_length("line"))
    deg = e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    e = e.join(deg.withColumnsRenamed({"node": "u", "d": "du"}), "u").join(deg.withColumnsRenamed({"node": "v", "d": "dv"}), "v")
    return e.where(~((F.least("du", "dv") == 1) & (F.col("length") < dangling) & (F.col("support") < support))).select("u", "v", "line", "support", "length")


def network_of(traces: DataFrame, **limits: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from traces by windows, groups, representatives and vertices."""
    subs = stored(subtrajectories(traces.select("id", "line")))
    reps = cut(representatives(subs, subtrajectory_groups(subs, **limits)))
    nodes = cut(vertices(reps))
    return nodes, vertex_edges(reps, nodes)


# ---- density skeleton


def skeleton(pts: DataFrame, pixel: float = 5.0, blur: int = 2, share: float = 0.15, tile: int = 256, margin: int = 24) -> DataFrame:
    """``(row, col)``: pixels of the thinned density of points: binned, blurred, cut at a share of the tile's maximum, thinned.

    Tiles are thinned with a margin of their neighbours' pixels, of which they keep their own; beyond a blob wider than the
    margin the skeleton may differ from one thinned in one piece.
    """
    w = F.when(F.col("speed") < 20, 2.0).when(F.col("speed") < 60, 1.0).otherwise(0.5) if "speed" in pts.columns else F.lit(1.0)
    cells = pts.groupBy(F.floor(F.col("y") / pixel).alias("row"), F.floor(F.col("x") / pixel).alias("col")).agg(F.sum(w).alias("w"))
    reach = margin + blur
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    dealt = cells.select("*", F.explode(span("row")).alias("tr")).select("*", F.explode(span("col")).alias("tc"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf.tr.iloc[0] * tile - reach, pdf.tc.iloc[0] * tile - reach
        n = tile + 2 * reach
        grid = np.zeros((n, n))
        np.add.at(grid, (pdf.row.to_numpy() - r0, pdf.col.to_numpy() - c0), pdf.w.to_numpy())
        k = np.exp(-0.5 * (np.arange(-blur, blur + 1) / max(blur / 2, 0.5)) ** 2)
        k /= k.sum()
        for axis in (0, 1):
            grid = np.apply_along_axis(lambda v: np.convolve(v, k, "same"), axis, grid)
        thin = thinned(grid > share * grid.max()) if grid.max() > 0 else np.zeros_like(grid, bool)
        rows, cols = np.nonzero(thin[reach : reach + tile, reach : reach + tile])
        return pd.DataFrame({"row": rows + r0 + reach, "col": cols + c0 + reach})

    return dealt.groupBy("tr", "tc").applyInPandas(run, "row long, col long")


def thinned(image: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning."""
    img = np.pad(image.astype(np.uint8), 1)
    while True:
        before = img.copy()
        for step in (0, 1):
            p = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            n = sum(x.astype(int) for x in p)
            a = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8))
            one, two = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if step == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            img = np.where((img == 1) & (n >= 2) & (n <= 6) & (a == 1) & (one == 0) & (two == 0), 0, img).astype(np.uint8)
        if (img == before).all():
            return img[1:-1, 1:-1].astype(bool)


def skeleton_lines(pixels: DataFrame, pixel: float = 5.0, shortest: float = 20.0, tolerance: float = 2.0) -> DataFrame:
    """Pixels of a skeleton as lines: neighbours linked, without the diagonals of corners, chains followed, simplified."""
    from roadloom.operators.centerlines import chains, path_lines

    p = pixels.distinct().withColumn("node", F.col("row") * F.lit(1 << 31) + F.col("col"))
    q = p.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("node").alias("v"))
    steps = p.select("row", "col", F.col("node").alias("u"), F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))))).alias("s"))
    e = steps.join(q, (F.col("row") + F.col("s.dr") == F.col("r2")) & (F.col("col") + F.col("s.dc") == F.col("c2")))
    straight = e.where("s.dr = 0 OR s.dc = 0").select("u", "v")
    # a diagonal is left out where two straight steps lead the same way
    slanted = e.where("s.dr <> 0 AND s.dc <> 0").select("u", "v", "row", "col", "s")
    corner = slanted.select("u", "v", F.explode(F.array(F.struct(F.col("row").alias("r"), (F.col("col") + F.col("s.dc")).alias("c")), F.struct((F.col("row") + F.col("s.dr")).alias("r"), F.col("col").alias("c")))).alias("k"))
    blocked = corner.join(p.select(F.col("row").alias("kr"), F.col("col").alias("kc")), (F.col("k.r") == F.col("kr")) & (F.col("k.c") == F.col("kc"))).select("u", "v").distinct()
    links = straight.unionByName(slanted.select("u", "v").join(blocked, ["u", "v"], "left_anti"))
    nodes = p.select("node", ((F.col("col") + 0.5) * pixel).alias("x"), ((F.col("row") + 0.5) * pixel).alias("y"))
    d = path_lines(chains(links), nodes).select(F.col("path").alias("id"), "line")
    return ln.per_line(d, lambda xy: [(simplify(xy, tolerance),)], f"line {ln.LINE}").where(g.line_length("line") >= shortest)
