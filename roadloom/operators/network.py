"""The directed road graph that traces spell, its statistics, weights and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators.windows import by_trace


def labelled(pts: DataFrame, cell: float = 30.0) -> DataFrame:
    """``pts`` plus ``node``: the grid cell a point rounds to (half to even, so that both engines agree)."""
    part = lambda c: F.bround(F.col(c) / cell).cast("long")
    return pts.withColumn("node", part("x") * F.lit(1 << 32) + part("y"))


def transitions(pts: DataFrame, most: float = 50.0) -> DataFrame:
    """Consecutive points of a trace that change node within ``most``: ``u, v, step, heading`` and the second point's columns."""
    d = pts.withColumns({"u": F.lag("node").over(by_trace()), "px": F.lag("x").over(by_trace()), "py": F.lag("y").over(by_trace())})
    d = d.withColumn("step", g.distance("px", "py", "x", "y")).where((F.col("u") != F.col("node")) & (F.col("step") > 0) & (F.col("step") <= most))
    return d.withColumn("v", F.col("node")).withColumn("heading", g.bearing("px", "py", "x", "y"))


#: Sums of points that have a weight or a day: the weight of the second point counts, and the speeds of probes.
_MORE = {
    "weight": "sum(weight) AS weighted_support",
    "day": "count(DISTINCT day) AS days",
    "source": "count(speed) FILTER (WHERE source = 'HPD') AS speed_count",
    "speed": "avg(speed) FILTER (WHERE source = 'HPD') AS speed_mean",
    "step": "var_pop(speed) FILTER (WHERE source = 'HPD') AS speed_var",
}


def edges(moves: DataFrame) -> DataFrame:
    """One row per directed edge with support, length, sources and direction statistics."""
    r = F.radians("heading")
    return moves.groupBy("u", "v").agg(
        F.count("*").alias("support"),
        F.sum("step").alias("length"),
        F.count_if(F.col("source") == "VPD").alias("vpd_support"),
        F.count_if(F.col("source") == "HPD").alias("hpd_support"),
        F.avg("speed").alias("mean_speed"),
        F.coalesce(F.stddev_pop("speed") / F.nullif(F.avg("speed"), F.lit(0.0)), F.lit(0.0)).alias("speed_cv"),
        F.hypot(F.avg(F.sin(r)), F.avg(F.cos(r))).alias("heading_consistency"),
        F.count_distinct("trace_id").alias("traces"),
        F.count_distinct("hour").alias("hours"),
        *(F.expr(made) for name, made in _MORE.items() if name in moves.columns),
    )


def nodes(pts: DataFrame) -> DataFrame:
    """One row per node: speed-weighted centre, mean altitude, number of points and, for points with a heading, its weighted circular mean."""
    w = F.col("speed")
    heading = [g.circular_mean("heading", "speed").alias("heading")] if "heading" in pts.columns else []
    return pts.groupBy("node").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"), F.avg("altitude").alias("altitude"), F.sum(w).alias("weight"), F.count("*").alias("point_count"), *heading)


def degrees(e: DataFrame) -> DataFrame:
    """Number of edge ends at every node."""
    return e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def with_reverse(e: DataFrame) -> DataFrame:
    """``e`` plus the support of the opposite edge, 0 if there is none."""
    r = e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("support").alias("reverse_support"))
    return e.join(r, ["u", "v"], "left").withColumn("reverse_support", F.coalesce("reverse_support", F.lit(0)))


def prune_weak(e: DataFrame, least: int = 2, ratio: float = 0.2) -> DataFrame:
    """Edges of enough support that are not a small share of their opposite edge."""
    return with_reverse(e.where(F.col("support") >= least)).where(F.col("support") >= ratio * F.col("reverse_support"))


def prune_transitive(e: DataFrame, ratio: float = 1.2, hops: int = 4, weak: int | None = None) -> DataFrame:
    """Drops edges (of support ``weak`` at most, where given) that a path of 2 to ``hops`` other edges replaces at at most ``ratio`` times their length.

    Judged on the graph as given. Paths grow by joins and are cut as soon as they are too long, so what is
    carried stays near the candidates; a path may use neither direction of the edge it would replace.
    """
    hop = e.select("u", "v", (F.col("length") / F.col("support")).alias("w"))
    goal = (e if weak is None else e.where(F.col("support") <= weak)).select(F.col("u").alias("s"), F.col("v").alias("t"), (F.col("length") / F.col("support") * ratio).alias("most"))
    reach = goal.select("s", "t", "most", F.col("s").alias("at"), F.lit(0.0).alias("dist"))
    found = None
    for k in range(hops):
        step = reach.join(hop, reach.at == hop.u).where("NOT (u = s AND v = t) AND NOT (u = t AND v = s)")
        reach = step.select("s", "t", "most", F.col("v").alias("at"), (F.col("dist") + F.col("w")).alias("dist")).where("dist <= most").groupBy("s", "t", "most", "at").agg(F.min("dist").alias("dist"))
        hit = reach.where("at = t").select(F.col("s").alias("u"), F.col("t").alias("v"))
        found = hit if found is None else found.unionByName(hit)
        if k + 1 < hops:
            reach = reach.where("at <> t")
    return e.join(found.distinct(), ["u", "v"], "left_anti")


def weighted_median(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """``(key, median)``: the first value at which half of the weight is reached. Equal values are added up first."""
    df = df.groupBy(key, value).agg(F.sum(weight).alias(weight))
    w = Window.partitionBy(key)
    d = df.withColumn("_c", F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum(weight).over(w))
    return d.where(F.col("_c") >= F.col("_t") / 2).groupBy(key).agg(F.min(value).alias("median"))


def raster(pts: DataFrame, pixel: float = 10.0) -> DataFrame:
    """Sparse density raster: speed-dependent weights per pixel."""
    w = F.when(F.col("speed") < 20, 2.0).when(F.col("speed") < 60, 1.0).otherwise(0.5)
    return pts.groupBy(F.floor(F.col("y") / pixel).alias("row"), F.floor(F.col("x") / pixel).alias("col")).agg(F.sum(w).alias("w"), F.count("*").alias("n"))


def complementarity(pts: DataFrame, cell: float) -> DataFrame:
    """``(kind, cells)``: cells that both sources, one of them or, within the box of all, neither reaches."""
    c = pts.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.bool_or(F.col("source") == "VPD").alias("v"), F.bool_or(F.col("source") == "HPD").alias("h"))
    seen = c.groupBy(F.when(F.col("v") & F.col("h"), "both").when(F.col("v"), "vpd_only").otherwise("hpd_only").alias("kind")).agg(F.count("*").alias("cells"))
    none = c.agg(F.lit("neither").alias("kind"), ((F.max("cx") - F.min("cx") + 1) * (F.max("cy") - F.min("cy") + 1) - F.count("*")).alias("cells"))
    return seen.unionByName(none)
