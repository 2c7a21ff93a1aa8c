"""Line kernels in numpy, run on Arrow batches, and order-dependent clustering by tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geometry import POINTS
from roadloom.operators import spatial
from roadloom.operators.graph import connected_components


def as_array(line) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Frechet distance of two vertex lists; infinite if one is empty."""
    if not len(a) or not len(b):
        return float("inf")
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    row = np.maximum.accumulate(d[0])
    for i in range(1, len(a)):
        reach = np.minimum(row, np.concatenate(([np.inf], row[:-1])))
        new, last = np.empty_like(row), np.inf
        for j in range(len(b)):
            last = max(d[i, j], min(last, reach[j]))
            new[j] = last
        row = new
    return float(row[-1])


def point_line_distances(p: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of every point to the nearest place of a line."""
    if len(line) == 1:
        return np.hypot(*(p - line[0]).T)
    a, d = line[:-1], np.diff(line, axis=0)
    n = (d**2).sum(axis=1)
    t = ((p[:, None, :] - a[None]) * d[None]).sum(axis=2) / np.where(n > 0, n, 1)
    near = a[None] + np.clip(t, 0, 1)[:, :, None] * d[None]
    return np.hypot(*(p[:, None, :] - near).transpose(2, 0, 1)).min(axis=1)


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Greatest distance of a vertex of either line from the other line."""
    if not len(a) or not len(b):
        return float("inf")
    return float(max(point_line_distances(a, b).max(), point_line_distances(b, a).max()))


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that Douglas-Peucker keeps at a tolerance."""
    keep = np.zeros(len(line), bool)
    if len(line):
        keep[[0, -1]] = True
    open_ = [(0, len(line) - 1)]
    while open_:
        i, j = open_.pop()
        if j - i < 2:
            continue
        d = point_line_distances(line[i + 1 : j], line[[i, j]])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[i + 1 + k] = True
            open_ += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[keep]


def frechet_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else frechet(as_array(p), as_array(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def hausdorff_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else hausdorff(as_array(p), as_array(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def simplify_column(line: Column, tolerance: float) -> Column:
    @F.pandas_udf(POINTS)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [{"x": float(u), "y": float(v)} for u, v in simplify(as_array(p), tolerance)] for p in x])

    return run(line)


def _cluster(x: np.ndarray, y: np.ndarray, heading: np.ndarray, radius: float, tolerance: float, weight: float) -> np.ndarray:
    """Label per point, in order: the best cluster in reach and direction, by distance plus weighted angle, or a new one."""
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy, sin, cos, n = [], [], [], [], []
    out = np.empty(len(x), np.int64)
    rad = np.radians(heading)
    for i in range(len(x)):
        a, b = int(x[i] // radius), int(y[i] // radius)
        best, score = -1, np.inf
        for u in (a - 1, a, a + 1):
            for v in (b - 1, b, b + 1):
                for k in cells.get((u, v), ()):
                    d = np.hypot(x[i] - cx[k], y[i] - cy[k])
                    if d > radius:
                        continue
                    turn = abs((heading[i] - np.degrees(np.arctan2(sin[k], cos[k])) + 180) % 360 - 180)
                    if turn <= tolerance and d + weight * turn < score:
                        best, score = k, d + weight * turn
        if best < 0:
            best = len(cx)
            cx.append(x[i]), cy.append(y[i]), sin.append(0.0), cos.append(0.0), n.append(0)
            cells.setdefault((a, b), []).append(best)
        n[best] += 1
        old = (int(cx[best] // radius), int(cy[best] // radius))
        cx[best] += (x[i] - cx[best]) / n[best]
        cy[best] += (y[i] - cy[best]) / n[best]
        sin[best] += np.sin(rad[i])
        cos[best] += np.cos(rad[i])
        new = (int(cx[best] // radius), int(cy[best] // radius))
        if new != old:
            cells[old].remove(best)
            cells.setdefault(new, []).append(best)
        out[i] = best
    return out


def cluster_points(pts: DataFrame, radius: float = 10.0, tolerance: float = 45.0, weight: float = 0.18, tile: float = 500.0) -> DataFrame:
    """``(event_id, cluster)``: heading-aware incremental clustering of points with columns ``x, y, heading``.

    Each tile is clustered in the order of trace and position; clusters of different tiles whose centres and
    directions agree are joined afterwards. Equal to one pass in sequence within a tile, not across its border.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["trace_id", "pos"])
        labels = _cluster(pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.heading.to_numpy(), radius, tolerance, weight)
        return pd.DataFrame({"event_id": pdf.event_id, "x": pdf.x, "y": pdf.y, "heading": pdf.heading, "tile": pdf.tile, "label": labels})

    tiled = pts.where("heading IS NOT NULL").withColumn("tile", F.floor(F.col("x") / tile) * 1000003 + F.floor(F.col("y") / tile))
    done = tiled.select("event_id", "trace_id", "pos", "x", "y", "heading", "tile").groupBy("tile").applyInPandas(run, "event_id long, x double, y double, heading double, tile long, label long")
    done = done.withColumn("id", F.xxhash64("tile", "label"))
    r = F.radians("heading")
    centres = done.groupBy("id", "tile").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum(F.sin(r)).alias("s"), F.sum(F.cos(r)).alias("c"))
    side = centres.select("id", "tile", F.atan2("s", "c").alias("h"))
    near = spatial.pairs(centres.select("id", "x", "y"), radius / 2)
    both = near.join(side.withColumnsRenamed({"id": "a", "tile": "ta", "h": "ha"}), "a").join(side.withColumnsRenamed({"id": "b", "tile": "tb", "h": "hb"}), "b")
    agree = both.where((F.col("ta") != F.col("tb")) & (F.cos(F.col("ha") - F.col("hb")) >= float(np.cos(np.radians(tolerance)))))
    joined = connected_components(agree, "a", "b")
    return done.join(joined, "id", "left").select("event_id", F.coalesce("component", "id").alias("cluster"))
