"""Joins of lines with lines and points, segment by segment, in DataFrame operations.

A line table has columns ``id`` and ``line``. Segments are cut into pieces no longer than a cell before they are dealt to
cells, so a long diagonal costs cells in proportion to its length, not to its box. One side is grown by the radius; the
join is an equi-join on cells, which Spark can shuffle, broadcast or split where a cell is crowded. No cross joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import coverage


def segments(lines: DataFrame) -> DataFrame:
    """``(id, seq, x1, y1, x2, y2, at, len, total)``: segments of some length, where each begins along its line, and the line's length."""
    s = lines.where(F.size("line") >= 2).select("id", "line", F.posexplode(F.expr("slice(line, 1, size(line) - 1)")).alias("seq", "p"))
    q = F.expr("line[seq + 1]")
    s = s.select("id", "seq", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")).withColumn("len", g.distance("x1", "y1", "x2", "y2")).where("len > 0")
    w = Window.partitionBy("id")
    return s.withColumn("at", F.sum("len").over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).withColumn("total", F.sum("len").over(w))


def _piece(size: float, grow: float, k: str, p: str = "", boxes: bool = False) -> tuple[str, dict[str, str]]:
    """SQL of the number of pieces of a segment, and of the first and last cells that piece ``k`` may touch when grown."""
    n = "1" if boxes else f"greatest(1, cast(ceil(hypot({p}x2 - {p}x1, {p}y2 - {p}y1) / {size}D) AS int))"
    end = lambda c, k: f"({p}{c}1 + ({p}{c}2 - {p}{c}1) * ({k}) / ({n}))"
    both = lambda c: f"{p}{c}1, {p}{c}2" if boxes else f"{end(c, k)}, {end(c, f'{k} + 1')}"
    cell = lambda c, f, s: f"cast(floor(({f}({both(c)}) {s} {grow}D) / {size}D) AS bigint)"
    return n, {c + e: cell(c, f, s) for c in "xy" for e, f, s in (("lo", "least", "-"), ("hi", "greatest", "+"))}


def _cells(segs: DataFrame, size: float, grow: float, boxes: bool = False) -> DataFrame:
    """``segs`` once for every cell that one of its pieces, of at most a cell's size, may touch when grown; with ``boxes`` all cells of its box."""
    n, b = _piece(size, grow, "k", boxes=boxes)
    cells = f"flatten(transform(sequence({b['xlo']}, {b['xhi']}), cx -> transform(sequence({b['ylo']}, {b['yhi']}), cy -> named_struct('cx', cx, 'cy', cy))))"
    if boxes:
        return segs.select("*", F.inline(F.expr(cells)))
    return segs.select("*", F.inline(F.expr(f"array_distinct(flatten(transform(sequence(0, {n} - 1), k -> {cells})))")))


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in ("cx", "cy") else p + c) for c in df.columns))


def near_segments(a: DataFrame, b: DataFrame, r: float, cell: float | None = None, boxes: bool = False) -> DataFrame:
    """Pairs of segments (columns ``a_*`` and ``b_*``) that may be within ``r``, each pair once.

    Two segments may share many cells: short ones give their pair in the first of them, and only pairs with a segment of
    more than one piece, which are few, are told apart by looking for an earlier pair of pieces that meets. No shuffle of pairs.
    With ``boxes`` all segments that share a cell of their boxes are pairs.
    """
    size, r = float(cell or max(4 * r, 20.0)), float(r)
    met = _prefixed(_cells(a, size, r, boxes), "a_").join(_prefixed(_cells(b, size, 0.0, boxes), "b_"), ["cx", "cy"])
    (na, ca), (nb, cb) = _piece(size, r, "0", "a_", boxes), _piece(size, 0.0, "0", "b_", boxes)
    first = " AND ".join(f"c{c} = greatest({ca[c + 'lo']}, {cb[c + 'lo']})" for c in "xy")
    if not boxes:
        (_, pa), (_, pb) = _piece(size, r, "i", "a_"), _piece(size, 0.0, "j", "b_")
        shared = " , ".join(f"greatest({pa[c + 'lo']}, {pb[c + 'lo']})" for c in "xy")
        meet = " AND ".join(f"greatest({pa[c + 'lo']}, {pb[c + 'lo']}) <= least({pa[c + 'hi']}, {pb[c + 'hi']})" for c in "xy")
        # the least first cell of all pieces that meet is one of the pair's cells
        firsts = f"flatten(transform(sequence(0, {na} - 1), i -> transform(sequence(0, {nb} - 1), j -> CASE WHEN {meet} THEN struct({shared}) END)))"
        first = f"CASE WHEN {na} = 1 AND {nb} = 1 THEN {first} ELSE struct(cx, cy) = array_min({firsts}) END"
    return met.where(first).drop("cx", "cy")


def point_to(p: str, s: str, k: int | str) -> Column:
    """Distance of end ``k`` of one segment from another."""
    return g.point_segment_distance(f"{p}_x{k}", f"{p}_y{k}", f"{s}_x1", f"{s}_y1", f"{s}_x2", f"{s}_y2")


def _cross(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({ax}) * ({by}) - ({ay}) * ({bx}))"


def _sides() -> dict[str, Column]:
    """On which side of a segment the ends of the other lie."""
    side = lambda s, p, k: F.expr(_cross(f"{s}_x2 - {s}_x1", f"{s}_y2 - {s}_y1", f"{p}_x{k} - {s}_x1", f"{p}_y{k} - {s}_y1"))
    return {"s1": side("b", "a", 1), "s2": side("b", "a", 2), "s3": side("a", "b", 1), "s4": side("a", "b", 2)}


def segment_distance() -> Column:
    """Exact distance of two segments: 0 where they cross, else the least distance of an end from the other one."""
    cross = (F.signum("s1") * F.signum("s2") < 0) & (F.signum("s3") * F.signum("s4") < 0)
    return F.when(cross, 0.0).otherwise(F.least(point_to("a", "b", 1), point_to("a", "b", 2), point_to("b", "a", 1), point_to("b", "a", 2)))


def within(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """``(a, b, dist)``: lines of either table at most ``r`` apart, with their exact distance."""
    d = near_segments(segments(a), segments(b), r).withColumns(_sides()).withColumn("dist", segment_distance()).where(F.col("dist") <= r)
    return d.groupBy(F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(F.min("dist").alias("dist"))


def touched(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """Ids of lines of ``a`` with a line of ``b`` within ``r``."""
    d = near_segments(segments(a), segments(b), r).withColumns(_sides()).where(segment_distance() <= r)
    return d.select(F.col("a_id").alias("id")).distinct()


def without_near(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """Lines of ``a`` with no line of ``b`` within ``r``."""
    return a.join(touched(a, b, r), "id", "left_anti")


def crossing_points(a: DataFrame, b: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """``(a, b, x, y, a_at, b_at)``: proper crossings of lines with the distances along both; of one table, each pair once.

    With ``totals`` also the lengths of both lines, ``a_total`` and ``b_total``.
    """
    s = segments(a)
    d = near_segments(s, s if b is None else segments(b), 0.0).withColumns(_sides()).where("signum(s1) * signum(s2) < 0 AND signum(s3) * signum(s4) < 0")
    d = d.where("a_id < b_id") if b is None else d
    d = d.withColumn("t", F.expr("s1 / nullif(s1 - s2, 0D)")).withColumn("u", F.expr("s3 / nullif(s3 - s4, 0D)"))
    return d.select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.expr("a_x1 + t * (a_x2 - a_x1)").alias("x"), F.expr("a_y1 + t * (a_y2 - a_y1)").alias("y"), F.expr("a_at + t * a_len").alias("a_at"), F.expr("b_at + u * b_len").alias("b_at"), *(("a_total", "b_total") if totals else ())
    )


#: Sorted intervals merged: those that touch become one.
_MERGE = """aggregate(array_sort({a}), cast(array() AS array<struct<lo:double,hi:double>>), (m, x) -> CASE WHEN size(m) > 0 AND x.lo <= element_at(m, -1).hi + 1e-9
 THEN concat(slice(m, 1, size(m) - 1), array(named_struct('lo', element_at(m, -1).lo, 'hi', greatest(element_at(m, -1).hi, x.hi)))) ELSE concat(m, array(x)) END)"""


def covered_intervals(a: DataFrame, b: DataFrame, r: float, others: bool = False) -> DataFrame:
    """``(id, total, inside)``: of each line of ``a`` its length and the merged stretches (distances along it) within ``r`` of ``b``.

    With ``others`` lines of the same id do not count.
    """
    d = coverage.stretches(a, b, r, others).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("raw"))
    totals = a.where(F.size("line") >= 2).select("id", g.line_length("line").alias("total")).where("total > 0").groupBy("id").agg(F.sum("total").alias("total"))
    return totals.join(d, "id", "left").select("id", "total", F.expr(f"coalesce({_MERGE.format(a='raw')}, cast(array() AS array<struct<lo:double,hi:double>>))").alias("inside"))


def length_within(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """``(id, total, inside_length)``: how much of each line of ``a`` lies within ``r`` of ``b``, overlaps counted once."""
    return covered_intervals(a, b, r).select("id", "total", F.expr("aggregate(inside, 0D, (s, x) -> s + x.hi - x.lo)").alias("inside_length"))


def uncovered_stretches(a: DataFrame, b: DataFrame, r: float, least: float = 0.0) -> DataFrame:
    """``(id, part, lo, hi)``: the stretches of each line of ``a`` farther than ``r`` from ``b``, longer than ``least``."""
    d = covered_intervals(a, b, r).withColumn("edges", F.expr("concat(array(0D), flatten(transform(inside, x -> array(x.lo, x.hi))), array(total))"))
    d = d.select("id", F.expr(f"filter(transform(sequence(0, size(edges) DIV 2 - 1), k -> named_struct('lo', edges[2 * k], 'hi', edges[2 * k + 1])), x -> x.hi - x.lo > {max(float(least), 1e-9)}D)").alias("out"))
    return d.select("id", F.posexplode("out").alias("part", "s")).select("id", "part", "s.lo", "s.hi")


def nearest_on_lines(points: DataFrame, lines: DataFrame, r: float, k: int = 1, other: Column | None = None, accept: Column | None = None) -> DataFrame:
    """``(pid, id, dist, px, py, at)``: the ``k`` nearest lines within ``r`` of each point (``pid, x, y``), with the nearest place on each.

    ``other`` may refuse pairs by the columns of points (``p_*``) and segments (``s_*``), ``accept`` by the nearest place on
    a segment as well (``qx, qy, dist``). Ties go to the smaller id.
    """
    size = max(2.0 * r, 20.0)
    c = lambda v: F.floor((F.col(v)) / size)
    p = points.select(*(F.col(n).alias("p_" + n) for n in points.columns), c("x").alias("cx"), c("y").alias("cy"))
    s = _prefixed(_cells(segments(lines), size, float(r)), "s_")
    d = p.join(s, ["cx", "cy"])
    d = d if other is None else d.where(other)
    t = F.expr("greatest(0D, least(1D, ((p_x - s_x1) * (s_x2 - s_x1) + (p_y - s_y1) * (s_y2 - s_y1)) / (s_len * s_len)))")
    d = d.withColumn("t", t).withColumn("qx", F.expr("s_x1 + t * (s_x2 - s_x1)")).withColumn("qy", F.expr("s_y1 + t * (s_y2 - s_y1)")).withColumn("dist", g.distance("p_x", "p_y", "qx", "qy")).where(F.col("dist") <= r)
    d = d if accept is None else d.where(accept)
    best = F.min(F.struct("dist", F.col("s_at").alias("seg"), F.col("qx").alias("px"), F.col("qy").alias("py"), F.expr("s_at + t * s_len").alias("at"))).alias("m")
    d = d.groupBy("p_pid", "s_id").agg(best).select(F.col("p_pid").alias("pid"), F.col("s_id").alias("id"), "m.dist", "m.px", "m.py", "m.at")
    if k == 1:
        return d.groupBy("pid").agg(F.min(F.struct("dist", "id", "px", "py", "at")).alias("m")).select("pid", "m.id", "m.dist", "m.px", "m.py", "m.at")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("pid").orderBy("dist", "id"))).where(F.col("k") <= k).drop("k")


def ends(lines: DataFrame) -> DataFrame:
    """``(id, end, x, y, heading)``: both ends of every line and the direction in which the line leaves there (outward)."""
    at = lambda k: F.element_at("line", k)
    out = lambda a, b: F.struct(at(a)["x"].alias("x"), at(a)["y"].alias("y"), g.bearing(at(b)["x"], at(b)["y"], at(a)["x"], at(a)["y"]).alias("heading"))
    return lines.where(F.size("line") >= 2).select("id", F.posexplode(F.array(out(1, 2), out(-1, -2))).alias("end", "e")).select("id", "end", "e.x", "e.y", "e.heading")


def mean_distance(a: DataFrame, b: DataFrame, pairs: DataFrame, step: float, least: int = 5) -> DataFrame:
    """``pairs`` (``a, b``) plus ``mean_dist``: mean distance of evenly spaced samples of line ``a`` from line ``b``."""
    from roadloom.operators.kernels import as_array, point_line_distances
    from roadloom.operators.lines import length, resample

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p = as_array(p)
            out.append(float(point_line_distances(resample(p, max(least, int(length(p) / step))), as_array(q)).mean()))
        return pd.Series(out, dtype="float64")

    d = pairs.join(a.select(F.col("id").alias("a"), F.col("line").alias("_la")), "a").join(b.select(F.col("id").alias("b"), F.col("line").alias("_lb")), "b")
    return d.select(*pairs.columns, run("_la", "_lb").alias("mean_dist"))
