"""Reading road maps, lines and boxes, and preparing a map as ground truth."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import lines as ln
from roadloom.operators import overlay
from roadloom.sources.traces import read_tabular

#: Columns that may hold a line as text, the first of them that a table has.
LINE_COLUMNS = ("geometry_wkt", "geom", "geometry")
NUMBERS = ("func_class", "ref_zlevel", "nref_zlevel", "fr_spd_lim", "to_spd_lim")

Box = tuple[float, float, float, float]


def road_map(raw: DataFrame, box: Box | None = None, numbers: tuple[str, ...] = NUMBERS) -> DataFrame:
    """All columns of a map with lines as text in ``geom``, a row for each part (``geom_part``), bad numbers null, lines that miss ``box`` left out."""
    if "geom" not in raw.columns:
        raise ValueError("a road map needs a column geom")
    d = raw.withColumns({c: F.col(c).try_cast("int") for c in numbers if c in raw.columns})
    d = d.select("*", F.posexplode(g.parse_wkt("geom")).alias("geom_part", "line")).drop("geom")
    return d if box is None else d.where(meets_box("line", box))


def meets_box(line: str, box: Box) -> Column:
    """Does a line have a point in a box, on a segment as well as at a vertex?"""
    x0, y0, x1, y1 = map(float, box)
    clip = lambda d, room: f"CASE WHEN {d} < 0 THEN named_struct('lo', ({room}) / ({d}), 'hi', 1D) WHEN {d} > 0 THEN named_struct('lo', 0D, 'hi', ({room}) / ({d})) WHEN {room} < 0 THEN named_struct('lo', 2D, 'hi', -1D) ELSE named_struct('lo', 0D, 'hi', 1D) END"
    p, q = f"{line}[i]", f"{line}[i + 1]"
    parts = [clip(f"({p}.x - {q}.x)", f"({p}.x - {x0}D)"), clip(f"({q}.x - {p}.x)", f"({x1}D - {p}.x)"), clip(f"({p}.y - {q}.y)", f"({p}.y - {y0}D)"), clip(f"({q}.y - {p}.y)", f"({y1}D - {p}.y)")]
    inside = f"greatest(0D, {', '.join(f'({x}).lo' for x in parts)}) <= least(1D, {', '.join(f'({x}).hi' for x in parts)})"
    return F.expr(f"exists(sequence(0, greatest(0, size({line}) - 2)), i -> size({line}) > 1 AND {inside})")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A table of lines: CSV or Parquet with a line as text in the first of ``LINE_COLUMNS`` it has; rows that do not parse are dropped."""
    d = read_tabular(spark, path)
    named = [c for c in LINE_COLUMNS if c in d.columns]
    if not named:
        raise ValueError(f"{path} has none of the columns {LINE_COLUMNS}")
    return d.withColumn("line", longest_part(named[0])).drop(named[0]).where("line IS NOT NULL")


def longest_part(text: str) -> Column:
    """The longest line of a text of one or more; null where there is none."""
    parts = F.transform(g.parse_wkt(text), lambda p: F.struct(F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda a, i: a + F.hypot(p[i]["x"] - p[i - 1]["x"], p[i]["y"] - p[i - 1]["y"])).alias("n"), p.alias("p")))
    return F.array_max(parts)["p"]


def read_box(spark: SparkSession, path: str) -> Box:
    """The last four numbers of a text file: west, south, east, north."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    found = [float(x) for x in re.findall(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", text)][-4:]
    if len(found) < 4 or found[0] >= found[2] or found[1] >= found[3]:
        raise ValueError(f"{path} does not end in four numbers of a box")
    return tuple(found)


def clipped(d: DataFrame, box: Box, longest: bool = True) -> DataFrame:
    """Lines cut at the edge of a box; of several parts the longest, or all of them."""
    return ln.per_line(d, lambda xy: [(p,) for p in ln.clip_to_box(xy, box, longest)], f"line {ln.LINE}")


def ground_truth(roads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with ``dir_travel`` as one capital letter, and their nodes (``node_id, x, y, links``) at the mean of their ends."""
    links = roads.withColumn("dir_travel", F.upper(F.substring(F.trim("dir_travel"), 1, 1))) if "dir_travel" in roads.columns else roads
    end = lambda c, k: links.select(F.col(c).alias("node_id"), F.element_at("line", k)["x"].alias("x"), F.element_at("line", k)["y"].alias("y"))
    nodes = end("ref_node_pvid", 1).unionByName(end("nref_node_pvid", -1)).where("node_id IS NOT NULL")
    return links, nodes.groupBy("node_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("links"))


def projected(d: DataFrame, zone: int = 34) -> DataFrame:
    """Lines of longitude and latitude in metres of a UTM zone."""
    return d.withColumn("line", F.transform("line", lambda p: g.utm(p["x"], p["y"], zone)))


def new_in(net: DataFrame, known: DataFrame, r: float = 15.0) -> DataFrame:
    """Stretches of lines farther than ``r`` from known ones, as lines."""
    gaps = overlay.uncovered_stretches(net, known, r).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("gaps"))
    return ln.per_line(net.join(gaps, "id"), lambda xy, gaps: enumerate(ln.substrings(xy, *(np.array([x[c] for x in gaps], float) for c in ("lo", "hi")))), f"part int, line {ln.LINE}", also=("gaps",), drop=("gaps",))
