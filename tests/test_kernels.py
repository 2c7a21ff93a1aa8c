import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions.geometry import POINTS
from roadloom.operators import cleaning, kernels
from roadloom.sources import sinks
from roadloom.streaming import edges


def test_frechet_equals_recursion():
    r = np.random.default_rng(0)
    for _ in range(10):
        a, b = r.normal(size=(6, 2)), r.normal(size=(5, 2))
        d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])

        def f(i, j, d=d):
            if i == 0 and j == 0:
                return d[0, 0]
            before = [f(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            return max(d[i, j], min(before))

        assert kernels.frechet(a, b) == pytest.approx(f(5, 4))
    assert kernels.frechet(a, b[:0]) == math.inf


def test_hausdorff_and_simplify(spark):
    a, b = np.array([(0.0, 0), (10, 0)]), np.array([(0.0, 3), (5, 4), (10, 3)])
    assert kernels.hausdorff(a, b) == pytest.approx(4)
    zig = np.array([(0.0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)])
    assert kernels.simplify(zig, 0.5).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    d = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.1), (2.0, 0.0)],), (None,)], f"line {POINTS}")
    assert [None if r[0] is None else len(r[0]) for r in d.select(kernels.simplify_column(F.col("line"), 0.5)).collect()] == [2, None]


def test_clustering_splits_directions(spark):
    rows = [(k, k % 2, k, 3.0 * (k % 5), 0.1 * k, 90.0 if k % 2 else 270.0) for k in range(40)]
    d = spark.createDataFrame(rows, "event_id long, trace_id long, pos long, x double, y double, heading double")
    got = {r.event_id: r.cluster for r in kernels.cluster_points(d, radius=20.0).collect()}
    assert len(got) == 40 and not {got[k] for k in range(0, 40, 2)} & {got[k] for k in range(1, 40, 2)}


def test_duplicates(spark):
    line = lambda y, n: [(float(x), float(y)) for x in range(0, n, 10)]
    d = spark.createDataFrame([(1, line(0, 100)), (2, line(4, 110)), (3, line(50, 100)), (4, line(2, 100)[::-1])], f"trace_id long, line {POINTS}")
    same, back = cleaning.duplicate_pairs(d, 12.0), cleaning.duplicate_pairs(d, 12.0, opposite=True)
    assert [(r.a, r.b) for r in same.collect()] == [(1, 2)]
    assert {(r.a, r.b) for r in back.collect()} == {(1, 4), (2, 4)}
    assert {r.trace_id for r in cleaning.keep_longest(d, same).collect()} == {2, 3, 4}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 2.0)])], f"trace_id long, line {POINTS}")
    sinks.write_lines(d, str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).first().geometry_wkt == "LINESTRING (0.0 0.0, 1.0 2.0)"
    m = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("b")).alias("m"))
    sinks.write_metrics(m, str(tmp_path / "metrics"))
    row = spark.read.parquet(str(tmp_path / "metrics" / "parquet")).first()
    assert row["m.a"] == 1 and row["m.b"] == "[2]"


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1L AS u, 2L AS v, 5D AS step UNION ALL SELECT timestamp'2024-01-01 00:20:00', 1L, 2L, 7D UNION ALL SELECT timestamp'2024-01-02 00:00:00', 1L, 2L, 1D")
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = edges.edge_support(s).writeStream.outputMode("complete").format("memory").queryName("support").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.support, r.length) for r in spark.table("support").collect()) == [(1, 1.0), (2, 12.0)]
