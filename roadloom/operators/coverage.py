"""What of lines lies near other lines, by tiles: no pairs of segments are listed.

Lines travel as runs of pieces, one row for each line and tile, sorted by tile. A piece of a line meets the others' pieces of
its tile a few at a time and stops as soon as it is covered from end to end, so a road drawn a thousand times costs each piece a
few neighbours only. Crowded tiles are dealt in blocks of both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.operators import lines as ln

#: Pieces of one side that a block of a tile holds, about; most pairs of pieces looked at in one step.
BLOCK = 200_000
PAIRS = 1 << 19


def _runs(lines: DataFrame, size: float, grow: float, own: bool) -> DataFrame:
    """``(id, cx, cy, pieces)``: lines cut into pieces of a quarter cell at most, gathered by the cell of their middle (``own``), with the
    distance along the line and the length of each, or by every cell that they touch when grown."""
    schema = lines.select("id").schema.add("cx", "long").add("cy", "long").add("pieces", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(k, xy) for k, xy in enumerate(ln.arrays_of(batch.column(1))) if xy is not None and len(xy) >= 2]
            if not some:
                continue
            row = np.concatenate([np.full(len(xy) - 1, k) for k, xy in some])
            at = np.concatenate([ln.along(xy)[:-1] for _, xy in some])
            p, q = np.concatenate([xy[:-1] for _, xy in some]), np.concatenate([xy[1:] for _, xy in some])
            length = np.hypot(*(q - p).T)
            keep = length > 0
            row, at, p, q, length = row[keep], at[keep], p[keep], q[keep], length[keep]
            n = np.maximum(1, np.ceil(length / (size / 4))).astype(np.int64)
            i = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            d = (q - p)[i]
            lo, hi = p[i] + d * (k / n[i])[:, None], np.where((k + 1 == n[i])[:, None], q[i], p[i] + d * ((k + 1) / n[i])[:, None])
            step = length[i] / n[i]
            cols = np.column_stack([lo, hi, at[i] + k * step, step] if own else [lo, hi])
            if own:
                cells, w = np.floor((lo + hi) / 2 / size).astype(np.int64), np.arange(len(i))
            else:
                first, last = np.floor((np.minimum(lo, hi) - grow) / size).astype(np.int64), np.floor((np.maximum(lo, hi) + grow) / size).astype(np.int64)
                span = last - first + 1
                m = span.prod(axis=1)
                w = np.repeat(np.arange(len(i)), m)
                j = np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m)
                cells = first[w] + np.stack([j // span[w, 1], j % span[w, 1]], axis=1)
            order = np.lexsort((w, cells[:, 1], cells[:, 0], row[i[w]]))
            w, cells = w[order], cells[order]
            r = row[i[w]]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(r) != 0) | (np.diff(cells, axis=0) != 0).any(axis=1)))) if len(w) else np.zeros(0, np.int64)
            ends = np.concatenate((new, [len(w)])) * cols.shape[1]
            packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cols[w].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r[new])), pa.array(cells[new, 0]), pa.array(cells[new, 1]), packed], names=schema.fieldNames())

    return lines.where(F.size("line") >= 2).select("id", "line").mapInArrow(run, schema)


def _intervals(a: np.ndarray, b: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The part (0 to 1) of each piece ``a`` within ``r`` of the piece ``b`` beside it, empty where the first is not less: what its line
    shares with two discs and a rectangle, all convex as is their union."""
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy, ex, ey = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1], b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
        aa, ee = dx * dx + dy * dy, ex * ex + ey * ey
        lo, hi = np.full(len(a), 2.0), np.full(len(a), -1.0)

        def disc(fx: np.ndarray, fy: np.ndarray) -> None:
            bb = dx * fx + dy * fy
            root = np.sqrt(bb * bb - aa * (fx * fx + fy * fy - r * r))
            np.fmin(lo, (-bb - root) / aa, out=lo)
            np.fmax(hi, (-bb + root) / aa, out=hi)

        def slab(p: np.ndarray, slope: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            one, two, flat = (least - p) / slope, (most - p) / slope, np.abs(slope) < 1e-12
            inside = (p >= least) & (p <= most)
            return np.where(flat, np.where(inside, -1e300, 1e300), np.minimum(one, two)), np.where(flat, np.where(inside, 1e300, -1e300), np.maximum(one, two))

        fx, fy = a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]
        disc(fx, fy)
        disc(a[:, 0] - b[:, 2], a[:, 1] - b[:, 3])
        u = slab(fx * ex + fy * ey, dx * ex + dy * ey, np.zeros(len(a)), ee)
        wide = r * np.sqrt(ee)
        v = slab(fx * ey - fy * ex, dx * ey - dy * ex, -wide, wide)
        one, two = np.maximum(u[0], v[0]), np.minimum(u[1], v[1])
        ok = one <= two
        return np.maximum(0, np.where(ok, np.minimum(lo, one), lo)), np.minimum(1, np.where(ok, np.maximum(hi, two), hi))


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals between 0 and 1 of several rows, those of a row that touch made one."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    rank = np.concatenate(([0], np.cumsum(np.diff(row) != 0))) if len(row) else row
    most = np.maximum.accumulate(hi + 4.0 * rank) if len(row) else hi
    new = np.concatenate(([True], lo[1:] + 4.0 * rank[1:] > most[:-1] + 1e-9)) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return row[first], lo[first], (np.maximum.reduceat(hi, first) if len(first) else hi)


def _covered(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, r: float, ida: np.ndarray | None, idb: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged intervals of pieces ``a`` covered by their ranges of ``b``; a piece covered whole looks no further."""
    row, lo, hi = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    open_, at, take = np.flatnonzero(last > first), first.copy(), 8
    while len(open_):
        found = [(row, lo, hi)]
        for s in range(0, len(open_), max(1, PAIRS // take)):
            o = open_[s : s + max(1, PAIRS // take)]
            n = np.minimum(take, last[o] - at[o])
            i = np.repeat(o, n)
            j = np.repeat(at[o] - (np.cumsum(n) - n), n) + np.arange(len(i))
            # only pieces whose boxes come near
            p, q = a[i], b[j]
            near = np.ones(len(i), bool) if ida is None else ida[i] != idb[j]
            for c in (0, 1):
                near &= (np.maximum(p[:, c], p[:, c + 2]) + r >= np.minimum(q[:, c], q[:, c + 2])) & (np.maximum(q[:, c], q[:, c + 2]) + r >= np.minimum(p[:, c], p[:, c + 2]))
            i, p, q = i[near], p[near], q[near]
            x, y = _intervals(p, q, r)
            some = x < y
            found.append((i[some], x[some], y[some]))
        row, lo, hi = _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
        whole = np.zeros(len(a), bool)
        whole[row[(lo <= 0) & (hi >= 1)]] = True
        at[open_] = np.minimum(last[open_], at[open_] + take)
        open_ = open_[(at[open_] < last[open_]) & ~whole[open_]]
        take = min(2 * take, 1 << 12)
    return row, lo, hi


def stretches(a: DataFrame, b: DataFrame, r: float, others: bool = False, cell: float | None = None) -> DataFrame:
    """``(id, lo, hi)``: stretches (distances along each line of ``a``) within ``r`` of ``b``, piece by piece: a line's stretches may touch.

    With ``others`` lines of the same id do not count.
    """
    r = float(r)
    size = float(cell or max(4 * r, 60.0))
    ra, rb = _runs(a, size, r, True), _runs(b, size, r + size / 8, False)
    tile = ["cx", "cy"]
    crowd = lambda d, c, n: d.groupBy(*tile).agg(F.ceil(F.sum(F.size("pieces")) / (n * BLOCK)).alias(c)).where(F.col(c) > 1)
    na, nb = crowd(ra, "na", 6), crowd(rb, "nb", 4)
    crowded = F.broadcast(na.join(nb, tile, "full").select(*tile, F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb")))
    part = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(n, F.lit(1)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)).cast("long") - 1))
    da = ra.join(crowded, tile, "left").select(*tile, part("na").alias("ka"), each("nb").alias("kb"), F.lit(0).alias("side"), "id", "pieces")
    db = rb.join(crowded, tile, "left").select(*tile, each("na").alias("ka"), part("nb").alias("kb"), F.lit(1).alias("side"), "id", "pieces")
    keys = [*tile, "ka", "kb", "side"]
    d = da.unionByName(db).repartition(*keys[:4]).sortWithinPartitions(*keys)
    schema = a.select("id").schema.add("lo", "double").add("hi", "double")

    def settle(t: pa.Table) -> pa.RecordBatch:
        k = np.column_stack([t.column(c).to_numpy() for c in keys])
        ids, count = t.column("id").combine_chunks(), t.column("pieces").combine_chunks().value_lengths().to_numpy()
        flat = t.column("pieces").combine_chunks().flatten().to_numpy()
        new = np.concatenate(([True], (np.diff(k[:, :4], axis=0) != 0).any(axis=1)))
        tile_of, is_b = np.cumsum(new) - 1, k[:, 4] == 1
        value_b = np.repeat(is_b, count)
        pa_, pb = flat[~value_b].reshape(-1, 6), flat[value_b].reshape(-1, 4)
        na, nb = count[~is_b] // 6, count[is_b] // 4
        ra_, rb_ = np.flatnonzero(~is_b), np.flatnonzero(is_b)
        per = np.bincount(tile_of[rb_], nb, minlength=tile_of[-1] + 1).astype(np.int64)
        last = np.cumsum(per)
        at = np.repeat(tile_of[ra_], na)
        codes = pa.array(ids).dictionary_encode().indices.to_numpy() if others else None
        own = lambda rows, n: None if codes is None else np.repeat(codes[rows], n)
        row, lo, hi = _covered(pa_, pb, (last - per)[at], last[at], r, own(ra_, na), own(rb_, nb))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(ra_, na)[row])), pa.array(pa_[row, 4] + lo * pa_[row, 5]), pa.array(pa_[row, 4] + hi * pa_[row, 5])], names=["id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole tiles only: the last one of what has come may go on in the next batch
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys[:4]])
            before = kept and any(kept[-1].column(c)[-1].as_py() != k[0, n] for n, c in enumerate(keys[:4]))
            if before:
                yield settle(pa.Table.from_batches(kept))
                kept = []
            cut_at = len(k) - int(np.argmax((k[::-1] != k[-1]).any(axis=1))) if (k != k[-1]).any() else 0
            if cut_at:
                yield settle(pa.Table.from_batches([*kept, batch.slice(0, cut_at)]))
                kept = []
            kept.append(batch.slice(cut_at))
        if kept:
            yield settle(pa.Table.from_batches(kept))

    return d.mapInArrow(run, schema)
