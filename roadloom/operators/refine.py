"""Refinement of a network of lines: spurs, crossings, sharp vertices, ends, fragments, dead ends, loops and stubs.

A network is a table ``id`` (long, within 2^61 of 0), ``line``, ``source`` and ``support``. Every step takes one and returns one.
Joins run on cells; what is sequential runs per line or per chain of fragments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import lines as ln
from roadloom.operators import overlay, overpasses, spatial
from roadloom.operators.graph import connected_components
from roadloom.session import cut, few, stored


def loaded(parts: DataFrame) -> DataFrame:
    """One row for each part of multi-part lines (``id``, ``lines``) of two points or more, with its length."""
    d = parts.select("*", F.posexplode("lines").alias("part", "line")).where(F.size("line") >= 2).drop("lines")
    return d.withColumn("length", g.line_length("line")).where("length > 0")


def keyed_ends(net: DataFrame) -> DataFrame:
    """Ends of lines with their place to 0.1 as key, how many ends share it, and an id of their own."""
    e = overlay.ends(net).withColumn("eid", F.col("id") * 2 + F.col("end")).withColumn("ex", F.bround("x", 1)).withColumn("ey", F.bround("y", 1))
    return e.join(e.groupBy("ex", "ey").agg(F.count("*").alias("degree")), ["ex", "ey"])


def intersections(net: DataFrame, r: float = 15.0, least: int = 3) -> DataFrame:
    """``(node, x, y, degree, members)``: ends within ``r`` of each other, gathered, where ``least`` or more lines meet.

    ``members`` has the first end of each line there with its direction.
    """
    e = overlay.ends(net).withColumn("eid", F.col("id") * 2 + F.col("end"))
    near = spatial.pairs(e.select(F.col("eid").alias("id"), "x", "y"), r)
    e = e.join(connected_components(near, "a", "b").withColumnsRenamed({"id": "eid", "component": "node"}), "eid", "left").withColumn("node", F.coalesce("node", "eid"))
    first = e.groupBy("node", "id").agg(F.min(F.struct("end", "heading")).alias("f"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    d = first.groupBy("node").agg((F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"), F.count("*").alias("degree"), F.collect_list(F.struct("id", "f.end", "f.heading")).alias("members"))
    return d.where(F.col("degree") >= least)


def without_spurs(net: DataFrame, r: float = 15.0, short: float = 8.0, tiny: float = 4.0, degrees: float = 60.0) -> DataFrame:
    """Lines of at most ``short`` that hang on an intersection by one end go, and tiny ones that leave it far from every other line."""
    m = intersections(net, r).select("node", F.explode("members").alias("m")).select("node", "m.id", "m.end", "m.heading")
    size = net.select("id", g.line_length("line").alias("length"))
    small = m.join(size.where(F.col("length") <= short), "id")
    # a line with both ends at one intersection has none that is far
    far = keyed_ends(net).select("id", F.col("end").alias("other"), "degree")
    hangs = small.join(far, "id").where("other <> end AND degree = 1").select("id")
    rest = m.select("node", F.col("id").alias("oid"), F.col("heading").alias("oh"))
    apart = small.where(F.col("length") < tiny).join(rest, "node").where("id <> oid").groupBy("id", "node").agg(F.min(g.angle_difference("heading", "oh")).alias("least")).where(F.col("least") > degrees).select("id")
    return net.join(hangs.unionByName(apart).distinct(), "id", "left_anti")


def with_levels(net: DataFrame, from_end: float = 1.0, degrees: float = 30.0) -> DataFrame:
    """``net`` plus ``z_level``: of two lines that cross steeply away from their ends the shorter passes over."""
    net = stored(net)
    upper = few(overpasses.passing_over(net.select("id", "line"), from_end, degrees).withColumn("z_level", F.lit(1)))
    return net.join(upper, "id", "left").withColumn("z_level", F.coalesce("z_level", F.lit(0)))


def _each(net: DataFrame, kernel) -> DataFrame:
    return ln.per_line(net, lambda xy: [(kernel(xy),)], f"line {ln.LINE}").select(*net.columns)


def without_sharp_vertices(net: DataFrame, degrees: float = 120.0) -> DataFrame:
    return _each(net, lambda xy: ln.without_sharp(xy, degrees))


def smoothed(net: DataFrame, tolerance: float = 2.0, residual: float = 2.0, most: float = 4.0) -> DataFrame:
    return _each(net, lambda xy: ln.spline_smooth(xy, tolerance, residual, most))


def without_jitter(net: DataFrame, chord: float = 15.0, degrees: float = 60.0, least: float = 50.0) -> DataFrame:
    return _each(net, lambda xy: ln.without_jitter(xy, chord, degrees, least))


def moved_ends(net: DataFrame, places: DataFrame) -> DataFrame:
    """Lines with ends put to other places (``id, end, x, y``)."""
    p = places.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("end", F.struct("x", "y")))).alias("moved"))
    d = net.join(p, "id", "left")
    line = "concat(array(coalesce(moved[0], line[0])), slice(line, 2, size(line) - 2), array(coalesce(moved[1], element_at(line, -1))))"
    return d.withColumn("line", F.when(F.col("moved").isNull(), F.col("line")).otherwise(F.expr(line))).select(*net.columns)


def snapped_ends(net: DataFrame, r: float = 12.0) -> DataFrame:
    """Ends within ``r`` of each other, chained, meet in their mean place."""
    e = overlay.ends(net).withColumn("eid", F.col("id") * 2 + F.col("end"))
    parts = connected_components(spatial.pairs(e.select(F.col("eid").alias("id"), "x", "y"), r), "a", "b")
    e = e.join(parts.withColumnsRenamed({"id": "eid"}), "eid")
    centre = e.groupBy("component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return moved_ends(net, e.select("id", "end", "component").join(centre, "component"))


def stitched(net: DataFrame, r: float = 25.0, least: float = 3.0, degrees: float = 90.0) -> DataFrame:
    """Fragments joined end to end: nearest free ends first, each end once, only where the bend is at most ``degrees``.

    Lines shorter than ``least`` take no part. A row takes the id, source and other columns of its chain's smallest id and
    the largest support; no fragment is lost.
    """
    e = keyed_ends(net.where(g.line_length("line") >= least)).cache()
    pairs = spatial.pairs(e.select(F.col("eid").alias("id"), "x", "y"), r).where(F.expr("a DIV 2 <> b DIV 2"))
    side = lambda p: e.select(F.col("eid").alias(p), F.col("x").alias(p + "x"), F.col("y").alias(p + "y"), F.col("heading").alias(p + "h"), F.col("degree").alias(p + "d"))
    d = pairs.join(side("a"), "a").join(side("b"), "b").where("NOT (ad > 1 AND bd > 1)")
    # outward directions: straight on is 180 apart, and the gap must lead from one to the other
    gap = g.bearing("ax", "ay", "bx", "by")
    d = d.where((g.angle_difference(F.col("ah"), F.col("bh") + 180) <= degrees) & ((F.col("dist") < 0.1) | (g.angle_difference(F.col("ah"), gap) <= degrees)))
    joins = cut(spatial.one_to_one(d.select("a", "b", "dist"), same=True))
    e.unpersist()
    comp = connected_components(joins.select(F.expr("a DIV 2").alias("src"), F.expr("b DIV 2").alias("dst")))
    own = comp.join(net, "id").join(joins.select(F.expr("a DIV 2").alias("id"), "a", "b").groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("links")), "id", "left")
    rest = [c for c in net.columns if c not in ("id", "line", "support")]
    kind = net.schema

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = {i: np.array([(p["x"], p["y"]) for p in v]) for i, v in zip(pdf.id, pdf.line, strict=True)}
        mate = {}
        for links in pdf.links:
            for k in links if links is not None else ():
                mate[k["a"]], mate[k["b"]] = k["b"], k["a"]
        tips = sorted(i * 2 + s for i in xy for s in (0, 1) if i * 2 + s not in mate)
        at, out = tips[0] if tips else min(xy) * 2, []
        for _ in xy:
            out.append(xy[at // 2] if at % 2 == 0 else xy[at // 2][::-1])
            at = mate.get(at ^ 1, -1)
            if at < 0:
                break
        whole = np.concatenate(out)
        whole = whole[ln.keep_distant(whole, 1e-6)] if len(whole) > 2 else whole
        first = pdf.sort_values("id").iloc[0]
        row = {"id": [first.id], "line": [[{"x": float(x), "y": float(y)} for x, y in whole]], "support": [pdf.support.max()]} | {c: [first[c]] for c in rest}
        return pd.DataFrame(row)[kind.fieldNames()]

    joined = own.groupBy("component").applyInPandas(chain, kind)
    return net.join(comp.select("id"), "id", "left_anti").select(*net.columns).unionByName(joined)


def bridges(net: DataFrame, nearest: float = 1.0, farthest: float = 37.5, degrees: float = 90.0) -> DataFrame:
    """Connectors ``(id, line, source, support)`` from dead ends to the nearest place of another line ahead of them."""
    e = keyed_ends(net).where("degree = 1").select(F.col("eid").alias("pid"), F.col("id").alias("own"), "x", "y", "heading")
    ahead = g.angle_difference("p_heading", g.bearing("p_x", "p_y", "qx", "qy")) <= degrees
    hit = overlay.nearest_on_lines(e, net.select("id", "line"), farthest, other=F.col("p_own") != F.col("s_id"), accept=(F.col("dist") >= nearest) & (F.col("dist") < farthest) & ahead)
    d = hit.join(e.select("pid", "x", "y"), "pid")
    return d.select((-F.col("pid") - 1).alias("id"), F.array(F.struct("x", "y"), F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).alias("line"), F.lit("bridge").alias("source"), F.lit(1.0).alias("support"))


def bridged(net: DataFrame, **limits: float) -> DataFrame:
    return net.unionByName(bridges(net, **limits), allowMissingColumns=True)


def is_loop(line: str = "line") -> Column:
    """Short lines that come back to where they began, or wind so much that they get nowhere."""
    size, apart = g.line_length(line), F.expr(f"hypot(element_at({line}, -1).x - {line}[0].x, element_at({line}, -1).y - {line}[0].y)")
    return ((apart < 10) & (size < 80)) | ((apart / F.greatest(size, F.lit(1e-9)) < 0.3) & (size < 100))


def without_loops(net: DataFrame) -> DataFrame:
    return net.where(~is_loop())


def without_stubs(net: DataFrame, short: float = 3.0, rounds: int = 1) -> DataFrame:
    """Lines shorter than ``short`` with a free end go, roundabouts excepted; repeated for what that frees."""
    for _ in range(rounds):
        free = keyed_ends(net).where("degree = 1").select("id").distinct()
        gone = net.where((g.line_length("line") < short) & (F.col("source") != "roundabout")).join(free, "id", "left_semi").select("id")
        net = net.join(gone, "id", "left_anti")
    return net


def cleaned(net: DataFrame, least: float = 4.0) -> DataFrame:
    """Lines of two points or more that are at least ``least`` long."""
    return net.where(F.size("line") >= 2).where(g.line_length("line") >= least)


def refined(net: DataFrame) -> DataFrame:
    """All steps in order, each cut off from the plan of the one before."""
    steps = (without_spurs, without_parallel, with_levels, without_sharp_vertices, smoothed, snapped_ends, stitched, bridged, without_jitter, without_loops, without_stubs, snapped_ends, stitched, bridged, cleaned)
    for step in steps:
        net = cut(step(net).withColumn("z_level", F.coalesce("z_level", F.lit(0))) if "z_level" in net.columns else step(net))
    return net


def without_parallel(net: DataFrame, corridor: float = 5.0, degrees: float = 20.0, overlap: float = 0.90, short: float = 0.3, short_overlap: float | None = None, mutual: float | None = None) -> DataFrame:
    """Of two lines of about one heading, one of which runs within ``corridor`` of the other, the one of lower score goes; of equals the longer.

    The score is length by support, 1.5 times for vehicle paths and 10 for roundabouts, which never go. Overlap is the share
    of the shorter line inside the corridor of the longer; lines of very different length may need ``short_overlap``, lines
    of like length may need the longer's share to reach ``mutual`` times the limit as well. Pairs are settled in the order
    of their ids within a component of pairs, those of lines already gone left out.
    """
    size = net.select("id", "line", "source", g.line_length("line").alias("length"), g.start_end_heading("line").alias("h"), F.coalesce(F.col("support").cast("double"), F.lit(1.0)).alias("support"))
    near = overlay.near_segments(overlay.segments(net), overlay.segments(net), corridor).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    side = lambda p: size.select(*(F.col(c).alias(p if c == "id" else p + "_" + c) for c in size.columns))
    d = near.join(side("a"), "a").join(side("b"), "b").where(g.axis_difference("a_h", "b_h") <= degrees)
    d = d.select("a", "b", *(f"{p}_{c}" for p in "ab" for c in ("length", "source", "support")), within_share(F.col("a_line"), F.col("b_line"), corridor).alias("sa"), within_share(F.col("b_line"), F.col("a_line"), corridor).alias("sb"))
    ratio = F.least("a_length", "b_length") / F.greatest("a_length", "b_length")
    shorter, longer = F.when(F.col("a_length") <= F.col("b_length"), F.col("sa")).otherwise(F.col("sb")), F.when(F.col("a_length") <= F.col("b_length"), F.col("sb")).otherwise(F.col("sa"))
    need = F.when(ratio < short, short_overlap if short_overlap is not None else overlap).otherwise(overlap)
    same = shorter >= need if mutual is None else (shorter >= need) & ((ratio <= 0.7) | (longer >= mutual * overlap))
    score = lambda p: F.col(p + "_length") * F.col(p + "_support") * F.when(F.col(p + "_source") == "roundabout", 10.0).when(F.upper(p + "_source") == "VPD", 1.5).otherwise(1.0)
    loses = F.when(score("a") != score("b"), F.when(score("a") < score("b"), F.col("a")).otherwise(F.col("b"))).otherwise(F.when(F.col("a_length") >= F.col("b_length"), F.col("a")).otherwise(F.col("b")))
    d = d.where(same).withColumn("gone", loses).where(F.when(F.col("gone") == F.col("a"), F.col("a_source")).otherwise(F.col("b_source")) != "roundabout").select("a", "b", "gone")
    d = cut(d)
    comp = connected_components(d, "a", "b")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for a, b, x in sorted(zip(pdf.a, pdf.b, pdf.gone, strict=True)):
            if a not in gone and b not in gone:
                gone.add(x)
        return pd.DataFrame({"id": sorted(gone)}, dtype="int64")

    lost = d.join(comp.withColumnsRenamed({"id": "a"}), "a").select("component", "a", "b", "gone").groupBy("component").applyInPandas(settle, "id long")
    return net.join(lost, "id", "left_anti")


def within_share(a: Column, b: Column, r: float, samples: int = 64) -> Column:
    """Share of one line within ``r`` of another, by even samples."""
    from roadloom.operators.kernels import as_array, point_line_distances

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float((point_line_distances(ln.resample(as_array(p), samples), as_array(q)) <= r).mean()) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def interchange_cleaned(net: DataFrame, r: float = 50.0, crowd: int = 5, short: float = 15.0, tiny: float = 7.5, sector: float = 30.0) -> DataFrame:
    """In crowded places, where ``crowd`` or more middles lie within ``r``, tiny lines go, and short ones off the main direction."""
    mid = ln.per_line(net.select("id", "line"), lambda xy: [(*ln.at_distance(xy, np.array([ln.length(xy) / 2]))[0].tolist(), float(ln.bearings(xy[-1] - xy[0]) % 180), ln.length(xy))], "x double, y double, h double, length double")
    near = spatial.pairs(mid.select("id", "x", "y"), r)
    n = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= crowd).select("id")
    zone = connected_components(near.join(n.withColumnRenamed("id", "a"), "a", "left_semi").join(n.withColumnRenamed("id", "b"), "b", "left_semi"), "a", "b")
    m = mid.join(zone, "id").withColumn("bin", F.floor(F.col("h") / sector))
    main = m.groupBy("component", "bin").agg(F.sum("length").alias("t")).groupBy("component").agg(F.max_by("bin", F.struct("t", -F.col("bin"))).alias("main"))
    gone = m.join(main, "component").where(((F.col("bin") != F.col("main")) & (F.col("length") < short)) | (F.col("length") < tiny)).select("id")
    return net.join(gone, "id", "left_anti")


def quality_selected(net: DataFrame) -> DataFrame:
    """Segments that the selection keeps, and all vehicle paths and roundabouts."""
    from roadloom.operators.scoring import scored_segments

    return scored_segments(net).where(F.col("is_selected") | F.col("source").isin("VPD", "roundabout")).select(*net.columns)
