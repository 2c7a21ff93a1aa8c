"""Lines that pass over others, against all crossings, and without listing them."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import lines as ln
from roadloom.operators import overlay, overpasses, refine


def from_all_crossings(net, from_end, degrees):
    x = overlay.crossing_points(net.select("id", "line"))
    size = net.select("id", g.line_length("line").alias("length"), g.start_end_heading("line").alias("h"), "line")
    side = lambda p: size.select(*(F.col(c).alias(p + ("" if c == "id" else "_" + c)) for c in size.columns))
    clear = lambda p: F.expr(f"NOT exists(array({p}_line[0], element_at({p}_line, -1)), q -> abs(q.x - x) <= {from_end}D AND abs(q.y - y) <= {from_end}D)")
    d = x.join(side("a"), "a").join(side("b"), "b").where(clear("a") & clear("b") & (g.axis_difference("a_h", "b_h") >= degrees))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("a", "b"))).where("n = 1")
    return {r.id for r in d.selectExpr("CASE WHEN a_length < b_length OR (a_length = b_length AND a > b) THEN a ELSE b END AS id").distinct().collect()}


def tangle(n, seed):
    """Wiggly lines in all directions, some straight and as long as others, some that repeat a vertex, turn back or have unknown places."""
    r = np.random.default_rng(seed)
    out = [(900, [(0.0, 0.0), (0.0, 0.0)]), (901, [(-20.0, 0.0), (float("nan"), 1.0), (-10.0, 3.0), (60.0, 30.0)]), (902, [(30.0, -20.0), (None, 1.0), (30.0, 5.0), (30.0, 60.0)])]
    out += [(910 + k, [(10.0 * k, -40.0), (10.0 * k, 40.0)]) for k in range(4)] + [(920 + k, [(-30.0, 10.0 * k), (50.0, 10.0 * k)]) for k in range(3)]
    for k in range(n):
        h = r.uniform(0, 2 * np.pi) + r.normal(0, 0.5, r.integers(1, 12))
        xy = np.cumsum(np.concatenate((r.uniform(-100, 100, (1, 2)), 12 * np.stack((np.sin(h), np.cos(h)), axis=1))), axis=0)
        out.append((k, np.repeat(xy, 1 + (r.random(len(xy)) < 0.1), axis=0).tolist()))
    return out


@pytest.mark.parametrize(("block", "first", "from_end", "degrees"), [(100_000, 16, 1.0, 30.0), (40, 1, 3.0, 60.0)])
def test_levels_equal_those_of_all_crossings(spark, monkeypatch, block, first, from_end, degrees):
    d = spark.createDataFrame(tangle(150, 7), f"id long, line {ln.LINE}")
    want = from_all_crossings(d, from_end, degrees)

    def listed(*_, **__):
        raise AssertionError("crossings are listed")

    monkeypatch.setattr(overlay, "crossing_points", listed)
    monkeypatch.setattr(overpasses, "BLOCK_POINTS", block)
    monkeypatch.setattr(overpasses, "FIRST", first)
    got = {r.id: r.z_level for r in refine.with_levels(d, from_end, degrees).collect()}
    assert {k for k, v in got.items() if v} == want and len(got) == d.count() and 20 < len(want) < 150


def test_settled_lines_meet_no_more(monkeypatch):
    import pyarrow as pa

    seen, real = [], overpasses._clear_crossings
    monkeypatch.setattr(overpasses, "_clear_crossings", lambda a, b, i, j, e: (seen.append(len(i)), real(a, b, i, j, e))[1])
    row = lambda k, xy, h: {"id": k, "line": [{"x": x, "y": y} for x, y in xy], "xlo": min(x for x, _ in xy), "xhi": max(x for x, _ in xy), "ylo": min(y for _, y in xy), "yhi": max(y for _, y in xy), "h": h, "length": float(abs(xy[1][0] - xy[0][0]) + abs(xy[1][1] - xy[0][1]))}
    short = [row(k, [(-5.0, k / 10), (500.0, k / 10)], 90.0) for k in range(300)]
    long = [row(1000 + k, [(float(k), -500.0), (float(k), 500.0)], 0.0) for k in range(400)]
    side = lambda rows: overpasses.Side(pa.Table.from_pylist(rows))
    assert overpasses._over(side(short), side(long), 1.0, 30.0).all() and sum(seen) == 300
    assert not overpasses._over(side(long), side(short), 1.0, 30.0).any()
