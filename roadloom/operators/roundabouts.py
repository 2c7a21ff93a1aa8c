"""Roundabouts: arcs of traces, circles through them, candidates that many arcs agree on, and what they do to a network."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators import lines as ln
from roadloom.operators import overlay, refine, spatial
from roadloom.operators.graph import connected_components
from roadloom.session import cut


def fitted_circle(xy: np.ndarray) -> tuple[float, float, float, float] | None:
    """Centre, radius and spread of radii of the least-squares circle; null for points in line."""
    a = np.column_stack((2 * xy, np.ones(len(xy))))
    shift = xy.mean(axis=0)
    a[:, :2] -= 2 * shift
    b = ((xy - shift) ** 2).sum(axis=1)
    if np.linalg.matrix_rank(a) < 3:
        return None
    (x, y, c), *_ = np.linalg.lstsq(a, b, rcond=None)
    r = np.sqrt(max(0.0, c + x * x + y * y))
    d = np.hypot(*(xy - shift - (x, y)).T)
    return float(x + shift[0]), float(y + shift[1]), float(r), float(d.std())


def arcs(traces: DataFrame, low: float = 6.0, high: float = 45.0, turn: float = 60.0, spread: float = 0.25, box: float = 5.0, least: int = 10) -> DataFrame:
    """``(id, x, y, r, spread, turned, heading)``: arcs of lines of ``least`` points or more that fit a circle of a radius within limits."""

    def kernel(xy):
        if len(xy) >= least:
            for a, b, total in ln.arc_runs(xy, turn):
                part = xy[a : b + 1]
                c = fitted_circle(part) if len(part) >= 3 else None
                if c and low <= c[2] <= high and c[3] <= spread * c[2] and np.ptp(part, axis=0).max() >= box:
                    yield *c, abs(total), float(ln.bearings(part[-1] - part[0]))

    return ln.per_line(traces.select("id", "line"), kernel, "x double, y double, r double, spread double, turned double, heading double")


def distinct_directions(headings: Column, apart: float = 45.0) -> Column:
    """How many directions of an array stay when each must be ``apart`` from the last counted one."""
    return F.aggregate(F.array_sort(headings), F.struct(F.lit(0).alias("n"), F.lit(-1e9).alias("last")), lambda a, h: F.when(h - a["last"] >= apart, F.struct((a["n"] + 1).alias("n"), h.alias("last"))).otherwise(a), lambda a: a["n"])


def candidates(found: DataFrame, r: float = 15.0, least_traces: int = 2, least_arcs: int = 3, few: int = 4, floor: float = 8.0) -> DataFrame:
    """``(rid, x, y, r, traces, arcs, directions)``: arcs whose centres lie within ``r``, chained, weighed by how far they turn.

    Needs enough traces or arcs; with few traces, two directions; radii must agree unless there are eight arcs.
    """
    a = cut(found.withColumn("aid", F.monotonically_increasing_id()))
    parts = connected_components(spatial.pairs(a.select(F.col("aid").alias("id"), "x", "y"), r), "a", "b").withColumnsRenamed({"id": "aid", "component": "rid"})
    d = a.join(parts, "aid", "left").withColumn("rid", F.coalesce("rid", "aid"))
    w = F.col("turned")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    c = d.groupBy("rid").agg(mean("x").alias("x"), mean("y").alias("y"), F.greatest(F.lit(floor), mean("r")).alias("r"), F.stddev_pop("r").alias("sd"), F.count_distinct("id").alias("traces"), F.count("*").alias("arcs"), F.avg(w).alias("turned"), F.collect_list("heading").alias("hs"))
    c = c.withColumn("directions", distinct_directions(F.col("hs")))
    ok = ((F.col("traces") >= least_traces) | (F.col("arcs") >= least_arcs)) & ((F.col("traces") > few) | (F.col("directions") >= 2)) & ((F.col("arcs") >= 8) | (F.col("sd") <= 0.35 * F.col("r")))
    return c.where(ok).drop("hs", "sd")


def validated(found: DataFrame, points: DataFrame, least_points: int = 12, least_traces: int = 2, sectors: int = 8, least_sectors: int = 5, coverage: float = 0.5, circular: float = 0.35, outliers: float = 0.4, size: tuple[float, float] = (6.0, 60.0), merge: float = 20.0) -> DataFrame:
    """Candidates borne out by the points (``id, x, y``) round them: enough, of enough traces, in enough sectors and of the circle in steps
    of 0.1 rad, at like distances and few far off; of those within ``merge`` of each other the one of most arcs stays."""
    near = spatial.within(found.where(F.col("r").between(*size)).select(F.col("rid").alias("id"), "x", "y"), points.select(F.monotonically_increasing_id().alias("id"), "x", "y", F.col("id").alias("trace")), size[1] * 1.5, keep=("trace",))
    d = near.join(found.select(F.col("rid").alias("a"), "x", "y", "r"), "a").where(F.col("dist") <= 1.5 * F.col("r")).withColumn("angle", F.atan2(F.col("by") - F.col("y"), F.col("bx") - F.col("x")) + F.pi())
    ring = F.col("dist") >= 0.5 * F.col("r")
    s = d.groupBy(F.col("a").alias("rid")).agg(
        F.count_if(ring).alias("points"),
        F.count_distinct("trace").alias("seen"),
        F.count_distinct(F.when(ring, F.floor(F.col("angle") / (2 * 3.141592653589793) * sectors))).alias("sectors"),
        F.count_distinct(F.when(ring, F.floor(F.col("angle") / 0.1))).alias("steps"),
        (F.stddev_pop(F.when(ring, F.col("dist"))) / F.avg(F.when(ring, F.col("dist")))).alias("uneven"),
        F.avg((F.abs(F.col("dist") - F.col("r")) > 5).cast("double")).alias("off"),
    )
    good = found.join(s, "rid").where((F.col("points") >= least_points) & (F.col("seen") >= least_traces) & (F.col("sectors") >= least_sectors) & (F.col("steps") / 63.0 >= coverage) & (F.col("uneven") <= circular) & (F.col("off") <= outliers))
    groups = connected_components(spatial.pairs(good.select(F.col("rid").alias("id"), "x", "y"), merge), "a", "b").withColumnsRenamed({"id": "rid", "component": "grp"})
    d = good.join(groups, "rid", "left").withColumn("grp", F.coalesce("grp", "rid"))
    best = d.groupBy("grp").agg(F.max(F.struct("arcs", F.col("points"), (-F.col("rid")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("rid"))
    return d.join(best, "rid", "left_semi").drop("grp")


def circle(x="x", y="y", r="r", n: int = 48) -> Column:
    """Closed ring of ``n`` points."""
    return F.expr(f"transform(sequence(0, {n}), k -> named_struct('x', {x} + {r} * cos(2 * pi() * (k % {n}) / {n}), 'y', {y} + {r} * sin(2 * pi() * (k % {n}) / {n})))")


def detect(traces: DataFrame, **limits: float) -> DataFrame:
    """Candidates with their rings, from all lines (``id, line``)."""
    return candidates(arcs(traces, **limits)).withColumn("line", circle())


def without_lines_inside(net: DataFrame, found: DataFrame, share: float = 0.70) -> DataFrame:
    """Lines more than ``share`` of which lie inside a zone of 1.3 r + 5 round a roundabout go; a segment counts by its middle."""
    s = ln.per_line(net.select("id", "line"), lambda xy: [(*p.tolist(), float(w)) for p, w in zip(ln.at_distance(xy, np.arange(0.5, 64) * ln.length(xy) / 64), np.full(64, 1 / 64), strict=True)], "x double, y double, w double")
    zone = found.select("x", "y", (1.3 * F.col("r") + 5).alias("zone"))
    most = 80.0
    hit = s.withColumn("cx", F.floor(F.col("x") / most)).withColumn("cy", F.floor(F.col("y") / most))
    z = zone.select(F.col("x").alias("zx"), F.col("y").alias("zy"), "zone", F.explode(F.expr(f"sequence(cast(floor((x - zone) / {most}) AS bigint), cast(floor((x + zone) / {most}) AS bigint))")).alias("cx"))
    z = z.select("*", F.explode(F.expr(f"sequence(cast(floor((zy - zone) / {most}) AS bigint), cast(floor((zy + zone) / {most}) AS bigint))")).alias("cy"))
    near = (hit.cx == z.cx) & (hit.cy == z.cy) & (F.hypot(hit.x - z.zx, hit.y - z.zy) <= z.zone)
    inside = hit.join(z, near, "left_semi").groupBy("id").agg(F.sum("w").alias("inside")).where(F.col("inside") > share).select("id")
    return net.join(inside, "id", "left_anti")


def with_ends_on_rings(net: DataFrame, found: DataFrame, nearest: float = 2.0, farthest: float = 25.0) -> DataFrame:
    """Ends 2 to 25 off a roundabout's ring are moved onto it; of several rings the last by number."""
    e = overlay.ends(net).withColumn("eid", F.col("id") * 2 + F.col("end"))
    most = farthest + 60.0
    d = spatial.within(e.select(F.col("eid").alias("id"), "x", "y"), found.select(F.col("rid").alias("id"), "x", "y"), most).join(found.select(F.col("rid").alias("b"), F.col("x").alias("cx"), F.col("y").alias("cy"), "r"), "b")
    d = d.join(e.select(F.col("eid").alias("a"), "id", "end", "x", "y"), "a").where((F.abs(F.col("dist") - F.col("r")) > nearest) & (F.abs(F.col("dist") - F.col("r")) < farthest) & (F.col("dist") > 0))
    last = d.groupBy("id", "end").agg(F.max(F.struct("b", "cx", "cy", "r", "x", "y", "dist")).alias("m")).select("id", "end", "m.*")
    return refine.moved_ends(net, last.select("id", "end", F.expr("cx + (x - cx) / dist * r").alias("x"), F.expr("cy + (y - cy) / dist * r").alias("y")))


def with_roundabouts(net: DataFrame, found: DataFrame) -> DataFrame:
    """The network without the lines that a roundabout replaces, drawn to its ring, and the rings themselves."""
    kept = with_ends_on_rings(without_lines_inside(net, found), found)
    rings = found.select((-F.abs("rid") - F.lit(1 << 40)).alias("id"), circle().alias("line"), F.lit("roundabout").alias("source"), F.col("arcs").cast("double").alias("support"))
    return kept.unionByName(rings, allowMissingColumns=True)


def rejections(found: DataFrame, points: DataFrame) -> DataFrame:
    """``(reason, n)``: how many candidates pass and how many do not."""
    good = validated(found, points).select("rid").withColumn("ok", F.lit(True))
    d = found.join(good, "rid", "left")
    return d.groupBy(F.when(F.col("ok"), "accepted").otherwise("not borne out by points").alias("reason")).agg(F.count("*").alias("n"))
