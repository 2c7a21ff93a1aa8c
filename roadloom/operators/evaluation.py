"""Scores of a network against a reference map, graph metrics and validation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import spatial
from roadloom.operators.graph import connected_components


def coverage(samples: DataFrame, other: DataFrame, r: float) -> DataFrame:
    """One row: how many samples (``id, x, y, len``) lie within ``r`` of ``other``, and their share by length."""
    hit = spatial.within(samples, other, r).select(F.col("a").alias("id")).distinct().withColumn("hit", F.lit(1))
    d = samples.join(hit, "id", "left")
    return d.agg(
        F.count("*").alias("samples"),
        F.count("hit").alias("matched"),
        F.sum("len").alias("length"),
        F.sum(F.when(F.col("hit") == 1, F.col("len")).otherwise(0.0)).alias("matched_length"),
    )


def score(candidate: DataFrame, truth: DataFrame, r: float) -> DataFrame:
    """One row with precision, recall and F1 by length; 0 where there is nothing to score."""
    p = coverage(candidate, truth, r).select(F.coalesce(F.col("matched_length") / F.nullif("length", F.lit(0.0)), F.lit(0.0)).alias("precision"), F.lit(1).alias("k"))
    q = coverage(truth, candidate, r).select(F.coalesce(F.col("matched_length") / F.nullif("length", F.lit(0.0)), F.lit(0.0)).alias("recall"), F.lit(1).alias("k"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return p.join(q, "k").select("precision", "recall", f1.alias("f1"))


def length_buckets(lengths: DataFrame, column: str = "length") -> DataFrame:
    """Count and total per bucket of length, by fixed bounds."""
    bounds = (0, 5, 10, 20, 50, 100, 200, 500)
    bucket = F.lit(0)
    for k, b in enumerate(bounds):
        bucket = F.when(F.col(column) >= b, k).otherwise(bucket)
    return lengths.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum(column).alias("total"))


def distance_summary(distances: DataFrame, column: str = "dist") -> DataFrame:
    """Mean, median and upper percentiles, interpolated linearly."""
    return distances.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median"), F.percentile(column, F.lit(0.9)).alias("p90"), F.percentile(column, F.lit(0.95)).alias("p95"))


def graph_metrics(e: DataFrame) -> DataFrame:
    """One row: nodes, undirected edges, components, largest component, dead ends and junctions."""
    u = e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    degree = u.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count()
    local = degree.agg(F.count("*").alias("nodes"), F.count_if(F.col("count") == 1).alias("dead_ends"), F.count_if(F.col("count") >= 3).alias("junctions")).withColumn("k", F.lit(1))
    sizes = connected_components(u, "u", "v").groupBy("component").count()
    whole = sizes.agg(F.count("*").alias("components"), F.max("count").alias("largest")).withColumn("k", F.lit(1))
    return u.agg(F.count("*").alias("edges")).withColumn("k", F.lit(1)).join(local, "k").join(whole, "k").drop("k")


def components(e: DataFrame) -> DataFrame:
    """``(component, nodes)`` of the undirected graph, named by the smallest node."""
    return connected_components(e, "u", "v").groupBy("component").agg(F.count("*").alias("nodes"))


def validation_report(pts: DataFrame, box: tuple[float, float, float, float], buffer: float = 0.01) -> DataFrame:
    """``(check, bad, total, status)``: one row per check, in one pass over the points."""
    x0, y0, x1, y1 = box
    out = ~(F.col("x").between(x0 - buffer, x1 + buffer) & F.col("y").between(y0 - buffer, y1 + buffer))
    tests = {"bounding_box": (out, "WARN"), "missing_position": (F.col("x").isNull() | F.col("y").isNull(), "FAIL"), "missing_speed": (F.col("speed").isNull(), "WARN"), "speed_range": (~F.col("speed").between(0, 250), "WARN"), "source": (~F.col("source").isin("VPD", "HPD"), "FAIL")}
    one = pts.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, (c, _) in tests.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("bad"), F.lit(level).alias("level")) for k, (_, level) in tests.items()))
    return one.select("total", F.inline(rows)).select("check", "bad", "total", F.when(F.col("bad") == 0, "PASS").otherwise(F.col("level")).alias("status"))


def heading_modality(headings: DataFrame, cell: float = 100.0, least: int = 5) -> DataFrame:
    """Per cell the number of peaks of a histogram of 10-degree bins (over 0.3 of its highest), joined within two bins and round the circle."""
    h = headings.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("heading") / 10).alias("bin")).agg(F.count("*").alias("n"))
    c = h.groupBy("cx", "cy").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    peaks = F.expr("transform(filter(bins, b -> b.n > 0.3D * top), b -> b.bin)")
    c = c.withColumn("peaks", peaks)
    groups = F.expr("size(filter(sequence(0, size(peaks) - 1), i -> i = 0 OR peaks[i] - peaks[i - 1] > 2))")
    wraps = F.expr("CASE WHEN peaks[0] + 36 - element_at(peaks, -1) <= 2 THEN 1 ELSE 0 END")
    modes = F.when(F.col("total") < least, 0).otherwise(F.greatest(F.lit(1), groups - wraps))
    return c.select("cx", "cy", F.col("total").alias("points"), modes.cast("long").alias("modes"))
