import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import lines as ln


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return row if len(columns) > 1 else row[0]


def line(*pts):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))


def with_line(spark, *pts):
    return spark.range(1).select(line(*pts).alias("ln")).withColumn("cum", g.cumulative("ln"))


@pytest.mark.parametrize(("h", "name"), [(0, "N"), (22.4, "N"), (22.5, "NE"), (337.4, "NW"), (337.5, "N"), (359.9, "N"), (90, "E"), (None, "UNKNOWN")])
def test_compass(spark, h, name):
    assert one(spark, c=g.compass(F.lit(h).cast("double"))) == name


def test_angles(spark):
    assert one(spark, a=g.angle_difference(F.lit(350.0), F.lit(10.0))) == pytest.approx(20)
    assert one(spark, a=g.axis_difference(F.lit(175.0), F.lit(5.0))) == pytest.approx(10)
    assert one(spark, a=g.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(90)
    assert one(spark, a=g.bearing_east(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(0)


def test_length_and_resample(spark):
    d = with_line(spark, (0, 0), (3, 4), (3, 10))
    row = d.select(g.line_length("ln").alias("n"), g.resample("ln", "cum", "3").alias("r"), g.densify("ln", "cum", 4).alias("d")).first()
    assert row.n == pytest.approx(11)
    assert (row.r[1].x, row.r[1].y) == pytest.approx((3, 4.5))
    assert len(row.d) == 4
    assert spark.range(1).select(line((1, 1)).alias("ln")).select(g.line_length("ln")).first()[0] == 0


def test_wkt(spark):
    texts = ["LINESTRING (1 2, 3 4)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "LINESTRING EMPTY", "LINESTRING (1 2)", "nonsense", None, "linestring (1e1 2, -3.5 4)", "LINESTRING (a b, 1 2)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(g.parse_wkt("t").alias("p")).collect()
    assert [len(r.p) for r in rows] == [1, 2, 0, 0, 0, 0, 1, 0]
    assert rows[6].p[0][0].x == 10 and rows[6].p[0][1].x == -3.5


def test_lists_and_flags(spark):
    d = spark.createDataFrame([("[1, 2]",), ("['1']",), ("[]",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in d.select(g.parse_numbers("t")).collect()] == [[1.0, 2.0], [1.0], [], [], [], []]
    f = spark.createDataFrame([("Yes",), (" yes ",), ("TRUE",), ("1",), ("no",), (None,)], "t string")
    assert [r[0] for r in f.select(g.flag("t")).collect()] == [True] * 4 + [False] * 2


def test_circle_curvature_sinuosity(spark):
    c = one(spark, c=g.circumcircle(*map(F.lit, (20.0, 0.0, 0.0, 20.0, -20.0, 0.0))))
    assert (c.x, c.y, c.r) == pytest.approx((0, 0, 20))
    assert one(spark, c=g.circumcircle(*map(F.lit, (0.0, 0.0, 1.0, 1.0, 2.0, 2.0)))) is None
    assert one(spark, c=g.menger(*map(F.lit, (20.0, 0.0, 0.0, 20.0, -20.0, 0.0)))) == pytest.approx(0.05)
    assert with_line(spark, (0, 0), (1, 0), (1, 1)).select(g.sinuosity("ln")).first()[0] == pytest.approx(2 / math.sqrt(2))


def test_smoothing_keeps_ends_and_turns(spark):
    d = with_line(spark, (0, 0), (10, 1), (20, 0), (20, 10))
    row = d.select(g.smooth("ln").alias("s"), g.smooth_keeping_turns("ln", 60).alias("t"), g.chaikin("ln").alias("c"), g.turn_indices("ln", 60).alias("i")).first()
    assert row.s[0].x == 0 and row.s[-1].y == 10 and row.s[1].y == pytest.approx(0.6)
    assert (row.t[2].x, row.t[2].y) == (20, 0)
    assert len(row.c) == 8 and row.i == [0, 2, 3]


def test_spikes_repeats_turns():
    at = lambda *p: np.array(p, float)
    assert ln.keep_distant(at((0, 0), (0, 0.01), (10, 0), (11, 8), (12, 0), (22, 0))).tolist() == [0, 2, 3, 4, 5]
    sharp = at((0, 0), (10, 0), (1, 0.1), (20, 0))
    assert sharp[ln.keep_unspiked(sharp)][:, 0].tolist() == [0, 1, 20]
    assert ln.keep_unspiked(at((0, 0), (5, 0), (5, 0), (9, 0))).tolist() == [0, 2, 3]  # a point on its neighbour goes
    u = at((0, 0), (10, 0), (0, 0.5))
    assert [len(u[s]) for s in ln.parts_between(3, ln.turn_starts(u, 95), True)] == [2, 2]
    assert ln.turn_starts(u, 95, progress=11.0) == [0]
    # the second of two gaps in a row does not cut: one point is no part
    assert ln.gap_starts(at((0, 0), (1, 0), (90, 0), (180, 0), (181, 0)), None, 60) == [0, 2]
    assert ln.gap_starts(at((0, 0), (1, 0), (2, 0)), [0, 1, 400], 60, 300) == [0, 2]


def test_utm_against_published_point(spark):
    """Central meridian of zone 34: easting is 500 km, northing the scaled meridian arc."""
    p = one(spark, p=g.utm(F.lit(21.0), F.lit(45.0)))
    assert p.x == pytest.approx(500000, abs=1e-3)
    assert p.y == pytest.approx(0.9996 * 4984944.378, abs=0.05)
