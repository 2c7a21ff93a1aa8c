"""Which lines pass over another one, without listing crossings.

A line passes over if some longer one crosses it steeply and once, so it is done with at the first such one. The longest lines of each place
settle nearly all; only the rest meets all lines, in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import lines as ln
from roadloom.operators.pairing import _ragged
from roadloom.session import few, stored

#: Points of a block of lines, two of which make a tile; the longest lines of a place that all lines meet first.
BLOCK_POINTS, FIRST = 100_000, 16
_BOX = ("xlo", "xhi", "ylo", "yhi")


class Side:
    """Lines of a block: their segments, boxes, ends, headings and lengths."""

    def __init__(self, table: pa.Table):
        column = lambda c: table.column(c).to_numpy()
        xy = [p for chunk in table.column("line").chunks for p in ln.arrays_of(chunk)]
        self.id, self.h = column("id"), column("h")
        self.length = np.nan_to_num(column("length"), nan=np.inf, posinf=np.inf)
        self.box = np.stack([column(c) for c in _BOX], axis=1)
        self.count = np.array([len(p) - 1 for p in xy])
        self.start = np.cumsum(self.count) - self.count
        self.p, self.q = np.concatenate([p[:-1] for p in xy]), np.concatenate([p[1:] for p in xy])
        self.ends = np.array([(p[0], p[-1]) for p in xy])
        self.low, self.high = np.minimum(self.p, self.q), np.maximum(self.p, self.q)

    def in_boxes(self, which: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments of lines that touch a box each, and the places of these lines in ``which``."""
        s, k = _ragged(self.start[which], self.count[which]), np.repeat(np.arange(len(which)), self.count[which])
        box = box[k]
        ok = (self.low[s, 0] <= box[:, 1]) & (self.high[s, 0] >= box[:, 0]) & (self.low[s, 1] <= box[:, 3]) & (self.high[s, 1] >= box[:, 2])
        return s[ok], k[ok]

    def clear(self, which: np.ndarray, at: np.ndarray, from_end: float) -> np.ndarray:
        return ~(np.abs(self.ends[which] - at[:, None]) <= from_end).all(axis=2).any(axis=1)


def _side(p: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (q[:, 0] - p[:, 0]) * (at[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (at[:, 0] - p[:, 0])


def _clear_crossings(a: Side, b: Side, i: np.ndarray, j: np.ndarray, from_end: float, most: int = 1 << 18) -> np.ndarray:
    """How often lines ``i`` of ``a`` and ``j`` of ``b`` properly cross away from the ends of both."""
    out = np.zeros(len(i), np.int64)
    step = max(1, most // max(1, int(max(a.count[i].max(initial=1), b.count[j].max(initial=1)))))
    for lo in range(0, len(i), step):
        u, v = i[lo : lo + step], j[lo : lo + step]
        sa, ka = a.in_boxes(u, b.box[v])
        sb, kb = b.in_boxes(v, a.box[u])
        n = np.bincount(kb, minlength=len(u))
        first = np.cumsum(n) - n
        ends, s = np.cumsum(n[ka]), 0
        while s < len(ka):
            t = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
            m = n[ka[s:t]]
            x, y, k = np.repeat(sa[s:t], m), sb[_ragged(first[ka[s:t]], m)], np.repeat(ka[s:t], m)
            s = t
            p1, p2, q1, q2 = a.p[x], a.q[x], b.p[y], b.q[y]
            s1, s2, s3, s4 = _side(q1, q2, p1), _side(q1, q2, p2), _side(p1, p2, q1), _side(p1, p2, q2)
            hit = np.flatnonzero((np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0))
            k, p1, p2, q1, q2, s1, s2, s3, s4 = (c[hit] for c in (k, p1, p2, q1, q2, s1, s2, s3, s4))
            # the place on the line of the smaller id
            own = (a.id[u[k]] < b.id[v[k]])[:, None]
            at = np.where(own, p1 + (s1 / (s1 - s2))[:, None] * (p2 - p1), q1 + (s3 / (s3 - s4))[:, None] * (q2 - q1))
            ok = a.clear(u[k], at, from_end) & b.clear(v[k], at, from_end)
            out[lo : lo + step] += np.bincount(k[ok], minlength=len(u))
    return out


def _over(a: Side, b: Side, from_end: float, degrees: float, most: int = 1 << 18) -> np.ndarray:
    """Rows of ``a`` that some longer line of ``b``, of equally long ones one of smaller id, crosses steeply and once."""
    done = np.zeros(len(a.id), bool)
    rows = max(1, most // max(1, len(b.id)))
    for lo in range(0, len(a.id), rows):
        r = slice(lo, lo + rows)
        box = a.box[r, None]
        near = (box[..., 0] <= b.box[:, 1]) & (box[..., 1] >= b.box[:, 0]) & (box[..., 2] <= b.box[:, 3]) & (box[..., 3] >= b.box[:, 2])
        size = a.length[r, None]
        near &= (size < b.length) | (size == b.length) & (a.id[r, None] > b.id)
        i, j = np.nonzero(near)
        turn = np.abs(a.h[lo + i] - b.h[j]) % 180
        steep = ~(np.minimum(turn, 180 - turn) < degrees)
        i, j = i[steep] + lo, j[steep]
        # a line is done with at its first hit, so each meets one, then twice as many
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        upto, take = 1, 1
        while len(i):
            now = rank < upto
            done[i[now][_clear_crossings(a, b, i[now], j[now], from_end) == 1]] = True
            more = ~now & ~done[i]
            i, j, rank = i[more], j[more], rank[more]
            take *= 2
            upto += take
    return done


def _grouped(d: DataFrame, size: float) -> DataFrame:
    """``d`` with ``grp``: blocks of lines of like boxes, or, of few lines, wherever they lie."""
    blocks = -(-(d.agg(F.sum(F.size("line"))).first()[0] or 1) // BLOCK_POINTS)
    if blocks <= 4:
        return d.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")))
    d = d.withColumn("cell", F.xxhash64(*(F.floor(F.col(c) / size) for c in _BOX)))
    n = d.groupBy("cell").agg(F.ceil(F.sum(F.size("line")) / BLOCK_POINTS).alias("n"))
    return d.join(few(n), "cell").withColumn("grp", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("n")))).drop("cell", "n")


def _met(a: DataFrame, b: DataFrame, size: float, from_end: float, degrees: float) -> DataFrame:
    """``(id)`` of lines of ``a`` that pass over one of ``b``."""
    a, b = _grouped(a, size), _grouped(b, size)
    side = size * 4

    def dealt(d: DataFrame, p: str) -> DataFrame:
        s = d.groupBy("grp").agg(F.min("xlo").alias("l"), F.max("xhi").alias("r"), F.min("ylo").alias("b"), F.max("yhi").alias("t"), F.min("length").alias("least"), F.max("length").alias("longest"))
        cells = lambda lo, hi: F.explode(F.expr(f"sequence(cast(floor({lo} / {side}D) AS bigint), cast(floor({hi} / {side}D) AS bigint))"))
        return few(s).select(*(F.col(c).alias(p + c) for c in s.columns), cells("l", "r").alias("cx")).select("*", cells(p + "b", p + "t").alias("cy"))

    first = f"cx = floor(greatest(a_l, b_l) / {side}D) AND cy = floor(greatest(a_b, b_b) / {side}D)"
    tiles = dealt(a, "a_").join(dealt(b, "b_"), ["cx", "cy"]).where(f"{first} AND a_l <= b_r AND b_l <= a_r AND a_b <= b_t AND b_b <= a_t AND a_least <= b_longest")
    tiles = few(tiles.select(F.col("a_grp").alias("ga"), F.col("b_grp").alias("gb")))
    lines = a.join(tiles, a.grp == tiles.ga).withColumn("own", F.lit(True)).unionByName(b.join(tiles, b.grp == tiles.gb).withColumn("own", F.lit(False))).drop("grp")
    name = dict(a.dtypes)["id"]

    def run(table: pa.Table) -> pa.Table:
        mine = table.column("own")
        x, y = Side(table.filter(mine)), Side(table.filter(pc.invert(mine)))
        return pa.table({"id": x.id[_over(x, y, from_end, degrees)]})

    return lines.groupBy("ga", "gb").applyInArrow(run, f"id {name}").distinct()


def passing_over(net: DataFrame, from_end: float = 1.0, degrees: float = 30.0) -> DataFrame:
    """``(id)`` of lines (``id, line``) that pass over another: of two that properly cross just once away from the ends of both, their headings
    ``degrees`` or more apart as axes, the shorter one, or that of greater id."""
    known = lambda c: f"filter(line.{c}, v -> NOT isnan(v))"
    box = [F.expr(f"array_{f}({known(c)})").alias(c + e) for c in "xy" for f, e in (("min", "lo"), ("max", "hi"))]
    d = net.where(F.size("line") >= 2).select("id", "line", *box, g.start_end_heading("line").alias("h"), g.line_length("line").alias("length"))
    d = stored(d.where("h IS NOT NULL AND xlo IS NOT NULL AND ylo IS NOT NULL"))
    extent, points = d.agg(F.avg(F.greatest(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"))), F.sum(F.size("line"))).first()
    size = max(float(extent or 1.0) / 3, 1e-9)
    if (points or 0) <= BLOCK_POINTS:
        return _met(d, d, size, from_end, degrees)
    place = Window.partitionBy(*(F.floor(F.col(c) / size) for c in _BOX)).orderBy(F.col("length").desc(), "id")
    # the window's rows have no lines
    longest = d.select("id", F.row_number().over(place).alias("k")).where(F.col("k") <= FIRST).select("id")
    some = few(_met(d, d.join(few(longest), "id", "left_semi"), size, from_end, degrees))
    rest = stored(d.join(some, "id", "left_anti"))
    return some.unionByName(_met(rest, d, size, from_end, degrees))
