"""Density clusters of points by tiles that see as far around them as it takes to tell; no pairs of dense points are listed."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import lines as ln
from roadloom.operators.graph import connected_components
from roadloom.operators.pairing import _ragged
from roadloom.session import few, stored

#: Side of a tile in radii.
TILE = 32


def _keyed(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each row of whole numbers (moved to begin at 2), and its factors; steps of up to 2 either way stay apart."""
    span = cells.max(axis=0) + 3
    factor = np.concatenate((np.cumprod(span[::-1])[::-1][1:], [1]))
    return cells @ factor, factor


def _neighbours(xy: np.ndarray, heading: np.ndarray | None, of: np.ndarray, eps: float, turn: float | None, least: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many others points ``of`` have near them, and, of those with fewer than ``least`` with themselves, each one and its distance."""
    cell = np.floor((xy - xy.min(axis=0)) / (eps * (1 + 1e-9))).astype(np.int64) + 2
    key, factor = _keyed(cell)
    order = np.argsort(key, kind="stable")
    key_, count, out = key[order], np.zeros(len(of), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    at = key[of][:, None] + factor[0] * np.array([-1, 0, 1])
    first, last = np.searchsorted(key_, at - 1, "left"), np.searchsorted(key_, at + 1, "right")
    ends, lo = np.cumsum((last - first).sum(axis=1)), 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        n = (last - first)[lo:hi]
        k = np.repeat(np.arange(lo, hi), n.sum(axis=1))
        i, j = of[k], order[_ragged(first[lo:hi].reshape(-1), n.reshape(-1))]
        d = np.hypot(xy[i, 0] - xy[j, 0], xy[i, 1] - xy[j, 1])
        ok = (d <= eps) & (i != j)
        if turn is not None:
            ok &= ln.angle(heading[i], heading[j]) <= turn
        k, j, d = k[ok], j[ok], d[ok]
        count[lo:hi] = np.bincount(k - lo, minlength=hi - lo)
        thin = count[k] + 1 < least
        out.append((of[k[thin]], j[thin], d[thin]))
        lo = hi
    return count, *(np.concatenate(c) for c in zip(*out, strict=True))


def _cells(xy: np.ndarray, heading: np.ndarray | None, eps: float, turn: float | None) -> tuple[np.ndarray, int]:
    """Cells whose points are all near each other, from 2 on, and into how many sectors the circle falls."""
    side, sectors = eps / 2**0.5 * (1 - 1e-9), int(-(-360.0 // turn)) if turn else 1
    place = np.floor((xy - xy.min(axis=0)) / side)
    # a sector is no wider than ``turn``; a little less where the circle does not fall into whole ones
    sector = np.minimum(np.floor(heading % 360 / (360 / sectors)), sectors - 1) if turn else np.zeros(len(xy))
    return np.concatenate((place, sector[:, None]), axis=1).astype(np.int64) + 2, sectors


def _linked(xy: np.ndarray, heading: np.ndarray | None, cells: np.ndarray, sectors: int, eps: float, turn: float | None, most: int = 1 << 18) -> np.ndarray:
    """A label per point, the same for points that hang together: boxes of cells settle most of them, points are compared where these do not."""
    key, factor = _keyed(cells)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    known, own = key[order][starts], cells[order][starts]
    values = np.concatenate((xy, (heading % 360)[:, None] if turn else np.zeros((len(xy), 1))), axis=1)[order]
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    members = np.split(order, starts[1:])
    parent = list(range(len(known)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    open_ = []
    reach = range(-2, 3) if sectors > 4 else range(sectors)
    for dx, dy, dh in product(range(-2, 3), range(-2, 3), reach):
        there = own + [dx, dy, 0]
        there[:, 2] = (own[:, 2] - 2 + dh) % sectors + 2
        to = there @ factor
        at = np.minimum(np.searchsorted(known, to), len(known) - 1)
        i = np.flatnonzero((known[at] == to) & (at > np.arange(len(known))))
        j = at[i]
        gap = np.maximum(0, np.maximum(low[i, :2] - high[j, :2], low[j, :2] - high[i, :2]))
        span = np.maximum(high[i, :2] - low[j, :2], high[j, :2] - low[i, :2])
        met, sure = np.hypot(*gap.T) <= eps, np.hypot(*span.T) <= eps * (1 - 1e-12)
        if turn:
            a, b = np.stack((low[i, 2], high[i, 2])), np.stack((low[j, 2], high[j, 2]))
            ways = [b + t for t in (-360.0, 0.0, 360.0)]
            met &= np.min([np.maximum(0, np.maximum(a[0] - w[1], w[0] - a[1])) for w in ways], axis=0) <= turn + 1e-6
            sure &= np.min([np.maximum(a[1] - w[0], w[1] - a[0]) for w in ways], axis=0) <= turn - 1e-6
        for p, q in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
            p, q = find(p), find(q)
            parent[max(p, q)] = min(p, q)
        rest = met & ~sure
        open_ += zip(i[rest].tolist(), j[rest].tolist(), strict=True)
    for p, q in open_:
        if find(p) == find(q):
            continue
        a, b = members[p], members[q]
        rows = max(1, most // len(b))
        for lo in range(0, len(a), rows):
            s = a[lo : lo + rows, None]
            near = np.hypot(xy[s, 0] - xy[b, 0], xy[s, 1] - xy[b, 1]) <= eps
            if turn:
                near &= ln.angle(heading[s], heading[b]) <= turn
            if near.any():
                u, v = find(p), find(q)
                parent[max(u, v)] = min(u, v)
                break
    label = np.empty(len(xy), np.int64)
    label[order] = np.repeat([find(k) for k in range(len(known))], np.diff(np.append(starts, len(xy))))
    return label


def _clustered(xy: np.ndarray, heading: np.ndarray | None, code: np.ndarray, known: np.ndarray, eps: float, least: int, turn: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Which points of a tile are dense, of those about which it can tell (``known``), and the cluster of each, -1 for none."""
    cells, sectors = _cells(xy, heading, eps, turn)
    _, at, n = np.unique(_keyed(cells)[0], return_inverse=True, return_counts=True)
    core = n[at.reshape(-1)] >= least
    look = np.flatnonzero(~core & known)
    count, i, j, d = _neighbours(xy, heading, look, eps, turn, least)
    core[look] = count + 1 >= least
    core &= known
    label, c = np.full(len(xy), -1), np.flatnonzero(core)
    if len(c):
        label[c] = _linked(xy[c], heading[c] if turn else None, cells[c], sectors, eps, turn)
        ok = core[j] & ~core[i]
        i, j, d = i[ok], j[ok], d[ok]
        nearest = np.lexsort((code[j], d, i))
        i, j = i[nearest], j[nearest]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        label[i[first]] = label[j[first]]
    return core, label


def density_clusters(pts: DataFrame, eps: float, least: int = 2, turn: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, cluster)`` and columns to ``keep`` of points (``id, x, y`` and, with ``turn``, ``heading``): points with ``least`` or more within
    ``eps``, themselves counted, hang together; others join the nearest such point; noise has no row. With ``turn`` only points of like
    heading are near. A cluster is the least id of its dense points."""
    eps, size, halo = float(eps), TILE * float(eps), 2.002 * float(eps)
    known = F.expr("coalesce(abs(x) < 1e17 AND abs(y) < 1e17, false)")
    known = known & F.expr("coalesce(abs(heading) < 1e17, false)") if turn is not None else known
    more = ["heading"] if turn is not None else []
    span = lambda c: f"sequence(cast(floor(({c} - {halo}D) / {size}D) AS bigint), cast(floor(({c} + {halo}D) / {size}D) AS bigint))"
    d = pts.where(known).select("id", "x", "y", *more, *(k for k in keep if k not in ("id", "x", "y", *more)))
    d = d.select("*", F.expr(span("x")).alias("sx"), F.expr(span("y")).alias("sy")).withColumn("shared", F.size("sx") * F.size("sy") > 1)
    d = d.select("*", F.explode("sx").alias("tx")).select("*", F.explode("sy").alias("ty")).drop("sx", "sy")
    fields = [f for f in d.schema if f.name in ("id", *keep)]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"part {d.schema['id'].dataType.simpleString()}, own boolean, core boolean, shared boolean"])

    def run(key, table):
        table = table.combine_chunks()
        c = lambda k: table.column(k).to_numpy()
        xy = np.stack((c("x").astype(float), c("y").astype(float)), axis=1)
        tile = np.array([key[0].as_py(), key[1].as_py()])
        own = (np.floor(xy / size).astype(np.int64) == tile).all(axis=1)
        # beyond little more than a radius from its border a tile does not see all that is near a point
        known = ((xy >= tile * size - halo / 2) & (xy <= (tile + 1) * size + halo / 2)).all(axis=1)
        ids = table.column("id").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        code = pc.rank(ids, tiebreaker="first").to_numpy().astype(np.int64) - 1
        core, label = _clustered(xy, c("heading").astype(float) if turn is not None else None, code, known, eps, least, turn)
        first = np.full(len(xy), len(xy))
        np.minimum.at(first, label[core], code[core])
        row = np.empty(len(xy), np.int64)
        row[code] = np.arange(len(xy))
        out = np.flatnonzero((label >= 0) & (own | core))
        part = ids.take(pa.array(row[first[label[out]]]))
        return pa.table([*(table.column(f.name).take(pa.array(out)) for f in fields), part, pa.array(own[out]), pa.array(core[out]), pa.array(c("shared")[out])], names=[*(f.name for f in fields), "part", "own", "core", "shared"])

    found = stored(d.groupBy("tx", "ty").applyInArrow(run, kind))
    own = found.where("own")
    # a dense point that several tiles see links their clusters
    links = own.where("core AND shared").select("id", F.col("part").alias("a")).join(found.where("NOT own").select("id", F.col("part").alias("b")), "id").where("a <> b").select("a", "b").distinct()
    parts = few(connected_components(links, "a", "b").withColumnRenamed("id", "part"))
    out = own.select("id", *(k for k in keep if k != "id"), "part").join(parts, "part", "left").select("id", F.coalesce("component", "part").alias("cluster"), *(k for k in keep if k != "id"))
    return out.unionByName(pts.where(~known).select("id", F.col("id").alias("cluster"), *(k for k in keep if k != "id"))) if least <= 1 else out
