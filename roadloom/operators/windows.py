"""Ordered operators on traces: steps, gaps, turns, windows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import lines as ln


def by_trace():
    return Window.partitionBy("trace_id").orderBy("pos")


def steps(pts: DataFrame) -> DataFrame:
    """``pts`` plus the previous point (``px, py``) and the distance from it; null at a trace's first point."""
    d = pts.withColumns({"px": F.lag("x").over(by_trace()), "py": F.lag("y").over(by_trace())})
    return d.withColumn("step", g.distance("px", "py", "x", "y"))


def cumulative(pts: DataFrame) -> DataFrame:
    return steps(pts).withColumn("along", F.sum(F.coalesce("step", F.lit(0.0))).over(by_trace().rowsBetween(Window.unboundedPreceding, 0)))


def central_headings(pts: DataFrame) -> DataFrame:
    """Heading from the previous to the next point, ends use themselves."""
    before = lambda c: F.coalesce(F.lag(c).over(by_trace()), F.col(c))
    after = lambda c: F.coalesce(F.lead(c).over(by_trace()), F.col(c))
    return pts.withColumn("heading", g.bearing(before("x"), before("y"), after("x"), after("y")))


def forward_headings(pts: DataFrame) -> DataFrame:
    """Heading to the next point; a trace's last point repeats the one before."""
    d = pts.withColumns({"nx": F.lead("x").over(by_trace()), "ny": F.lead("y").over(by_trace())}).withColumn("h", g.bearing("x", "y", "nx", "ny"))
    return d.withColumn("heading", F.coalesce("h", F.lag("h").over(by_trace()))).drop("nx", "ny", "h")


def trace_arrays(pts: DataFrame, *columns: str) -> DataFrame:
    """``(trace_id, line, <columns>)``: points of a trace in order as one row, other columns as arrays."""
    p = F.array_sort(F.collect_list(F.struct("pos", "x", "y", *columns)))
    d = pts.groupBy("trace_id").agg(p.alias("p"))
    return d.select("trace_id", F.expr("transform(p, q -> named_struct('x', q.x, 'y', q.y))").alias("line"), *(F.col(f"p.{c}").alias(c) for c in columns))


def sessions(traces: DataFrame, max_step: float, max_seconds: float | None = None) -> DataFrame:
    """``(trace_id, session, first_pos, n)``: traces (``line`` and, with ``max_seconds``, ``second``) cut at gaps in space or time, but
    only where the part so far has two points or more."""

    def kernel(xy, *second):
        starts = ln.gap_starts(xy, second[0] if second else None, max_step, max_seconds)
        for k, part in enumerate(ln.parts_between(len(xy), starts, False)):
            yield k, part.start, part.stop - part.start

    timed = ("second",) if max_seconds is not None else ()
    return ln.per_line(traces.select("trace_id", "line", *timed), kernel, "session long, first_pos long, n long", also=timed, drop=timed)


def sliding(pts: DataFrame, size: int, step: int) -> DataFrame:
    """``(trace_id, win, first_pos, last_pos)``: windows of ``size`` points every ``step``, and a last one at the end."""
    n = pts.groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") >= size)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("n") - size, F.lit(step)), F.array(F.col("n") - size)))
    d = n.select("trace_id", F.posexplode(starts).alias("win", "first_pos"))
    return d.select("trace_id", F.col("win").cast("long"), F.col("first_pos").cast("long"), (F.col("first_pos") + size - 1).cast("long").alias("last_pos"))


def chunks(traces: DataFrame, length: float) -> DataFrame:
    """``(trace_id, chunk, line)``: whole segments up to the one that reaches ``length``; the rest of a trace is its last chunk."""
    return ln.per_line(traces.select("trace_id", "line"), lambda xy: enumerate(ln.chunk_by_length(xy, length)), f"chunk int, line {ln.LINE}")


def substrings(lines: DataFrame, most: float) -> DataFrame:
    """``(trace_id, part, line)``: equal parts of at most ``most``, by arc length, with the line's inner vertices."""
    return ln.per_line(lines.select("trace_id", "line"), lambda xy: enumerate(ln.cut_evenly(xy, most)), f"part int, line {ln.LINE}")


def turn_parts(lines: DataFrame, degrees: float = 95.0, progress: float = 0.0) -> DataFrame:
    """``(trace_id, part, line)``: cut at sharp turns, whose vertex both parts share, once a part has come ``progress``."""
    kernel = lambda xy: ((k, xy[s]) for k, s in enumerate(ln.parts_between(len(xy), ln.turn_starts(xy, degrees, progress), True)))
    return ln.per_line(lines.select("trace_id", "line"), kernel, f"part int, line {ln.LINE}")


def windows_by_distance(lines: DataFrame, spacing: float = 5.0, length: float = 65.0, step: float = 18.0) -> DataFrame:
    """``(trace_id, win, line)``: windows of about ``length`` every ``step`` along evenly resampled traces, and a last one at the end."""
    from roadloom.operators.clustering import subtrajectories

    d = subtrajectories(lines.withColumnRenamed("trace_id", "id"), length, step, spacing)
    return d.select(F.col("id").alias("trace_id"), "win", "line")


#: Step, turn, shortest part, gap and tolerance of simplification by source.
PRESETS = {"VPD": (8.0, 95.0, 15.0, 60.0, 1.0), "HPD": (10.0, 110.0, 20.0, 120.0, 2.0)}


def preprocess(lines: DataFrame, source: str = "VPD") -> DataFrame:
    """``(trace_id, segment_part, line)``: repeats and spikes out, cut at gaps and sharp turns, resampled, simplified, resampled; short parts dropped."""
    step, turn, least, gap, tolerance = PRESETS[source]
    return ln.per_line(lines.select("trace_id", "line"), lambda xy: enumerate(ln.preprocessed(xy, step, turn, least, gap, tolerance)), f"segment_part int, line {ln.LINE}")
