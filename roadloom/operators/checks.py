"""Validation of traces, probes and maps: one row per check, in one pass over each table, and a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g

ORDER = ("crs", "bounding_box", "fused", "geometry", "integrity", "missing")


def _row(d: DataFrame, check: str, bad: Column, level: str, what: str) -> DataFrame:
    one = d.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.count("*").alias("total"))
    return one.select(F.lit(check).alias("check"), F.lit(what).alias("dataset"), "bad", "total", F.when(F.col("bad") == 0, "PASS").otherwise(level).alias("status"))


def crs(spark, names: dict[str, str | None], wanted: str = "EPSG:4326") -> DataFrame:
    """Does every dataset name the wanted reference system?"""
    rows = [("crs", k, int(v != wanted), 1, "PASS" if v == wanted else "FAIL") for k, v in names.items()]
    return spark.createDataFrame(rows, "check string, dataset string, bad long, total long, status string")


def bounding_box(d: DataFrame, box: tuple[float, float, float, float], what: str, buffer: float = 0.01) -> DataFrame:
    """Lines with a vertex outside a box, a little tolerance given."""
    x0, y0, x1, y1 = box
    out = F.exists("line", lambda p: ~(p["x"].between(x0 - buffer, x1 + buffer) & p["y"].between(y0 - buffer, y1 + buffer)))
    return _row(d, "bounding_box", out, "WARN", what)


def fused(d: DataFrame, what: str = "vpd") -> DataFrame:
    if "fused" not in d.columns:
        return d.agg(F.count("*").alias("total")).select(F.lit("fused").alias("check"), F.lit(what).alias("dataset"), F.col("total").alias("bad"), "total", F.lit("WARN").alias("status"))
    return _row(d, "fused", ~g.flag("fused"), "FAIL", what)


def broken(line: str = "line") -> Column:
    """No line, fewer than two points, a place that is no number, or no length."""
    return F.col(line).isNull() | (F.size(line) < 2) | F.exists(line, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])) | (g.line_length(line) <= 0)


def geometry(d: DataFrame, what: str) -> DataFrame:
    return _row(d, "geometry", broken(), "FAIL", what)


def integrity(d: DataFrame, what: str = "hpd") -> DataFrame:
    """Traces of fewer than two points."""
    return _row(d, "integrity", F.col("point_count") < 2, "FAIL", what)


def missing(d: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    """One row for each critical column: rows without a value, all of them if the table has no such column."""
    rows = [_row(d, "missing:" + c, F.col(c).isNull() if c in d.columns else F.lit(True), "WARN", what) for c in columns]
    return reduce(DataFrame.unionByName, rows)


def valid(d: DataFrame, line: str = "line") -> DataFrame:
    return d.where(~broken(line))


def run_all(vpd: DataFrame, hpd: DataFrame, nav: DataFrame, box: tuple[float, float, float, float], systems: dict[str, str | None], critical: dict[str, tuple[str, ...]]) -> DataFrame:
    """All checks in a fixed order (``step``)."""
    data = {"vpd": vpd, "hpd": hpd, "nav": nav}
    rows = [crs(vpd.sparkSession, systems), *(bounding_box(d, box, k) for k, d in data.items()), fused(vpd), *(geometry(d, k) for k, d in data.items()), integrity(hpd), *(missing(data[k], c, k) for k, c in critical.items() if c)]
    step = F.array_position(F.array(*map(F.lit, ORDER)), F.split("check", ":")[0])
    return reduce(DataFrame.unionByName, rows).withColumn("step", step.cast("int"))


def report(checks: DataFrame) -> str:
    """The checks as text; they are few."""
    lines = [f"{r.status:5} {r.check} ({r.dataset}): {r.bad} of {r.total}" for r in checks.orderBy("step", "dataset", "check").collect()]
    failed = sum(x.startswith("FAIL") for x in lines)
    return "\n".join([*lines, f"{failed} of {len(lines)} checks failed"])
