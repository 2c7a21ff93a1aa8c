"""Order-dependent operators on single lines, as numpy kernels that run on Arrow batches.

``per_line`` feeds every line of a table to a kernel as an ``(n, 2)`` array and gives back the other columns with what
the kernel returns, none, one or several rows. A kernel sees one line at a time, so no operator here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from roadloom.operators.kernels import point_line_distances, simplify

LINE = "array<struct<x:double,y:double>>"


def arrays_of(column: pa.Array) -> list[np.ndarray | None]:
    """The lines of an Arrow column; null for null."""
    flat, ends = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], axis=1)
    parts = np.split(xy, ends[:-1]) if len(ends) else []
    return [p if v else None for p, v in zip(parts, column.is_valid().to_pylist(), strict=True)]


def _arrow(values: list, kind: T.DataType) -> pa.Array:
    target = to_arrow_type(kind)
    if kind.simpleString() != LINE:
        return pa.array(values, target)
    n = np.array([0 if v is None else len(v) for v in values], np.int32)
    flat = np.concatenate([np.zeros((0, 2)), *(v for v in values if v is not None)])
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(target.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), points).cast(target)


def per_line(df: DataFrame, kernel: Callable[..., Iterable[tuple]], added: str, line: str = "line", also: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``df`` (but ``line``, ``drop`` and those replaced) and ``added`` ones, a row for every tuple the kernel returns.

    The kernel gets the line and the columns ``also`` of its row. Null lines give no rows; empty tables and lines none either.
    """
    new = T.StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in (line, *drop, *new.fieldNames())]
    shape = T.StructType([*(df.schema[c] for c in kept), *new.fields])
    n, also_at = len(kept), list(also)

    def run(batches):
        for batch in batches:
            own, rows = [], []
            extra = [batch.column(n + 1 + k).to_pylist() for k in range(len(also_at))]
            for i, xy in enumerate(arrays_of(batch.column(n))):
                if xy is not None and len(xy):
                    for out in kernel(xy, *(e[i] for e in extra)):
                        own.append(i)
                        rows.append(out)
            at = pa.array(own, pa.int64())
            cols = [batch.column(k).take(at) for k in range(n)] + [_arrow([r[k] for r in rows], f.dataType) for k, f in enumerate(new.fields)]
            yield pa.RecordBatch.from_arrays(cols, names=shape.fieldNames())

    return df.select(*kept, line, *also).mapInArrow(run, shape)


# ---- measures


def along(xy: np.ndarray) -> np.ndarray:
    """Distance along the line at every vertex."""
    return np.concatenate(([0.0], np.hypot(*np.diff(xy, axis=0).T).cumsum()))


def at_distance(xy: np.ndarray, d: np.ndarray) -> np.ndarray:
    s = along(xy)
    return np.stack([np.interp(d, s, xy[:, k]) for k in (0, 1)], axis=1)


def length(xy: np.ndarray) -> float:
    return float(along(xy)[-1])


def bearings(d: np.ndarray) -> np.ndarray:
    return np.degrees(np.arctan2(d[..., 0], d[..., 1])) % 360


def angle(a, b):
    return np.abs((np.asarray(a) - b + 180) % 360 - 180)


def turns(xy: np.ndarray) -> np.ndarray:
    """Turn at every inner vertex, 0 to 180 degrees."""
    h = bearings(np.diff(xy, axis=0))
    return angle(h[1:], h[:-1])


def resample(xy: np.ndarray, n: int) -> np.ndarray:
    """``n`` points evenly along the line; two or fewer are its ends, a line of no length repeats its first point."""
    if n <= 2:
        return xy[[0, -1]]
    return at_distance(xy, np.linspace(0, length(xy), n)) if length(xy) > 0 else np.repeat(xy[:1], n, axis=0)


def substring(xy: np.ndarray, a: float, b: float) -> np.ndarray:
    """The part between two distances along the line, with its inner vertices."""
    s = along(xy)
    inner = xy[(s > a) & (s < b)]
    return np.concatenate((at_distance(xy, np.array([a])), inner, at_distance(xy, np.array([b]))))


def substrings(xy: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """``substring`` for many stretches of one line at once."""
    s = along(xy)
    first, last = np.searchsorted(s, a, "right"), np.searchsorted(s, b, "left")
    n = np.maximum(0, last - first)
    start = np.cumsum(n + 2) - (n + 2)
    out = np.empty((int((n + 2).sum()), 2))
    out[start], out[start + n + 1] = at_distance(xy, a), at_distance(xy, b)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(start, n) + 1 + k] = xy[np.repeat(first, n) + k]
    return np.split(out, start[1:])


def middles(df: DataFrame) -> DataFrame:
    """``df`` (``line`` not empty) plus ``x, y`` half way along each line, ``heading`` from its first to its last point and ``length``; short lines together."""
    kept = [c for c in df.columns if c != "line"]
    shape = T.StructType([*(df.schema[c] for c in kept), df.schema["line"], *(T.StructField(c, T.DoubleType()) for c in ("x", "y", "heading", "length"))])

    def run(batches):
        for batch in batches:
            column = batch.column(len(kept))
            count = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            batch, count = batch.filter(pa.array(count > 0)), count[count > 0]
            if not batch.num_rows:
                continue
            flat = batch.column(len(kept)).flatten()
            flat = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], axis=1)
            start, out = np.cumsum(count) - count, np.empty((len(count), 4))
            for n in np.unique(count):
                at = np.flatnonzero(count == n)
                xy = flat[start[at][:, None] + np.arange(n)]
                if n == 1:
                    out[at] = np.column_stack([xy[:, 0], np.zeros((len(at), 2))])
                    continue
                step = np.diff(xy, axis=1)
                s = np.concatenate([np.zeros((len(at), 1)), np.hypot(step[:, :, 0], step[:, :, 1]).cumsum(axis=1)], axis=1)
                half, row = s[:, -1] / 2, np.arange(len(at))
                j = np.minimum((s <= half[:, None]).sum(axis=1), n - 1) - 1
                gap = s[row, j + 1] - s[row, j]
                mid = np.where(gap[:, None] > 0, step[row, j] / np.where(gap > 0, gap, 1)[:, None] * (half - s[row, j])[:, None] + xy[row, j], xy[:, -1])
                out[at] = np.column_stack([mid, bearings(xy[:, -1] - xy[:, 0]), s[:, -1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, k]) for k in range(4))], names=shape.fieldNames())

    return df.select(*kept, "line").mapInArrow(run, shape)


# ---- cleaning of traces


def keep_distant(xy: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Indices of points at least ``least`` from the last one kept."""
    keep = [0]
    for i in range(1, len(xy)):
        if np.hypot(*(xy[i] - xy[keep[-1]])) >= least:
            keep.append(i)
    return np.array(keep)


def keep_unspiked(xy: np.ndarray, degrees: float = 150.0, edge: float = 60.0) -> np.ndarray:
    """Indices without inner points that turn back next to a short edge, or that stand on a neighbour; judged from the last two kept."""
    if len(xy) < 3:
        return np.arange(len(xy))
    keep = [0]
    for i in range(1, len(xy) - 1):
        into, out = xy[i] - xy[keep[-1]], xy[i + 1] - xy[i]
        near = min(np.hypot(*into), np.hypot(*out))
        if near == 0 or angle(bearings(out), bearings(into)) >= degrees and near <= edge:
            continue
        keep.append(i)
    return np.array([*keep, len(xy) - 1])


def gap_starts(xy: np.ndarray, times, max_step: float, max_seconds: float | None = None) -> list[int]:
    """Where sessions begin: at a gap in space or time, if the session before it has two points or more."""
    step = np.hypot(*np.diff(xy, axis=0).T)
    late = np.zeros(len(step), bool) if max_seconds is None or times is None else np.diff(np.asarray(times, float)) > max_seconds
    out = [0]
    for i in np.flatnonzero((step > max_step) | late) + 1:
        if i - out[-1] >= 2:
            out.append(int(i))
    return out


def turn_starts(xy: np.ndarray, degrees: float = 95.0, progress: float = 0.0) -> list[int]:
    """Vertices at which a line is cut for a sharp turn, once it has come ``progress`` from the last cut."""
    s, out = along(xy), [0]
    for i in np.flatnonzero(turns(xy) >= degrees) + 1 if len(xy) > 2 else ():
        if s[i] - s[out[-1]] >= progress and i > out[-1]:
            out.append(int(i))
    return out


def parts_between(n: int, starts: list[int], shared: bool) -> list[slice]:
    """Slices of ``n`` points from cut to cut; ``shared`` gives a cut's vertex to both parts."""
    ends = [*(s + shared for s in starts[1:]), n]
    return [slice(a, b) for a, b in zip(starts, ends, strict=True)]


def step_points(xy: np.ndarray, step: float) -> np.ndarray:
    """Distances 0, step, 2 step, ... and the whole length."""
    total = length(xy)
    d = np.arange(0, total, step)
    return np.append(d, total) if len(d) and total - d[-1] > 1e-9 else d if len(d) else np.array([0.0])


def chunk_by_length(xy: np.ndarray, most: float) -> list[np.ndarray]:
    """Runs of whole segments that end with the one that reaches ``most``; the rest is the last chunk."""
    s, out, first = along(xy), [], 0
    for i in range(1, len(xy)):
        if s[i] - s[first] >= most or i == len(xy) - 1:
            if s[i] > s[first]:
                out.append(xy[first : i + 1])
            first = i
    return out


def cut_evenly(xy: np.ndarray, most: float) -> list[np.ndarray]:
    """Equal parts of at most ``most``, with the line's inner vertices."""
    total = length(xy)
    n = max(1, int(np.ceil(total / most)))
    return [substring(xy, total * k / n, total * (k + 1) / n) for k in range(n)]


def preprocessed(xy: np.ndarray, step: float = 8.0, turn: float = 95.0, least: float = 15.0, gap: float = 60.0, tolerance: float = 1.0, progress: float = 0.0) -> list[np.ndarray]:
    """Repeats and spikes out, split at gaps and turns, resampled, simplified, resampled; short parts dropped."""
    xy = xy[keep_distant(xy)]
    xy = xy[keep_unspiked(xy)]
    out = []
    for a in parts_between(len(xy), gap_starts(xy, None, gap), False):
        piece = xy[a]
        for b in parts_between(len(piece), turn_starts(piece, turn, progress), True) if len(piece) > 1 else ():
            part = piece[b]
            if len(part) < 2 or length(part) < least:
                continue
            part = simplify(at_distance(part, step_points(part, step)), tolerance)
            part = at_distance(part, step_points(part, step))
            if length(part) >= least:
                out.append(part)
    return out


def arc_runs(xy: np.ndarray, least_turn: float = 60.0, least_segments: int = 3) -> list[tuple[int, int, float]]:
    """Runs of segments that bend to one side: first and last vertex and the sum of turns in degrees."""
    h = bearings(np.diff(xy, axis=0))
    d = (np.diff(h) + 180) % 360 - 180
    out, first = [], 0
    for i in range(1, len(d) + 1):
        if i == len(d) or np.sign(d[i]) != np.sign(d[first]):
            total = float(d[first:i].sum())
            if d[first] != 0 and i - first + 1 >= least_segments and abs(total) >= least_turn:
                out.append((first, i + 1, total))
            first = i
    return out


# ---- curves


def smooth(xy: np.ndarray, weight: float, fixed: np.ndarray) -> np.ndarray:
    out = xy.copy()
    out[1:-1] = weight * xy[:-2] + (1 - 2 * weight) * xy[1:-1] + weight * xy[2:]
    out[fixed] = xy[fixed]
    return out


def fixed_at_turns(xy: np.ndarray, degrees: float) -> np.ndarray:
    fixed = np.ones(len(xy), bool)
    if len(xy) > 2:
        fixed[1:-1] = turns(xy) >= degrees
    return fixed


def smooth_keeping_turns(xy: np.ndarray, passes: int = 1, degrees: float = 35.0, weight: float = 0.2, once: bool = False) -> np.ndarray:
    """Three-point smoothing; turns stay, found before every pass or, with ``once``, before the first (weight then at most 0.49)."""
    fixed = fixed_at_turns(xy, degrees)
    for _ in range(passes if len(xy) > 2 else 0):
        xy = smooth(xy, min(max(weight, 0.0), 0.49) if once else weight, fixed if once else fixed_at_turns(xy, degrees))
    return xy


def chaikin(xy: np.ndarray, rounds: int = 1, skip_first: bool = False) -> np.ndarray:
    """Corner cutting that keeps the ends; ``skip_first`` leaves out the first point cut of the first segment."""
    for _ in range(rounds if len(xy) > 2 else 0):
        q = np.stack((0.75 * xy[:-1] + 0.25 * xy[1:], 0.25 * xy[:-1] + 0.75 * xy[1:]), axis=1).reshape(-1, 2)
        xy = np.concatenate((xy[:1], q[skip_first:], xy[-1:]))
    return xy


def merge_close(xy: np.ndarray, least: float, degrees: float) -> np.ndarray:
    """Points nearer than ``least`` to the last kept one go, unless they turn by more than ``degrees``."""
    keep = [0]
    for i in range(1, len(xy) - 1):
        turn = angle(bearings(xy[i + 1] - xy[i]), bearings(xy[i] - xy[keep[-1]]))
        if np.hypot(*(xy[i] - xy[keep[-1]])) >= least or turn > degrees:
            keep.append(i)
    return xy[[*keep, len(xy) - 1]] if len(xy) > 1 else xy


def curvatures(xy: np.ndarray) -> np.ndarray:
    """Menger curvature at inner vertices, 0 where a side is under 0.1."""
    a, b, c = xy[:-2], xy[1:-1], xy[2:]
    sides = np.stack([np.hypot(*(p - q).T) for p, q in ((a, b), (b, c), (a, c))])
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1])) / 2
    return np.where(sides.min(axis=0) < 0.1, 0.0, 4 * area / np.maximum(sides.prod(axis=0), 1e-12))


def curved_sections(xy: np.ndarray, least: float = 0.01, points: int = 3) -> list[tuple[int, int]]:
    """First and last vertex of runs of ``points`` or more of high curvature."""
    high = np.concatenate(([False, False], curvatures(xy) > least, [False])) if len(xy) > 2 else np.zeros(2, bool)
    edge = np.flatnonzero(np.diff(high.astype(int)))
    return [(int(a) + 0, int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= points]


def adaptive_simplify(xy: np.ndarray, tolerance: float, least: float = 0.01) -> np.ndarray:
    """Simplified with half the tolerance in curved sections and twice of it between them."""
    cuts = sorted({0, len(xy) - 1, *(k for s in curved_sections(xy, least) for k in s)})
    curved = {s[0] for s in curved_sections(xy, least)}
    out = [xy[:1]]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append(simplify(xy[a : b + 1], tolerance * (0.5 if a in curved else 2.0))[1:])
    return np.concatenate(out)


def simplify_and_smooth(xy: np.ndarray, close: float = 2.0, tolerance: float = 1.0, degrees: float = 35.0) -> np.ndarray:
    return smooth_keeping_turns(adaptive_simplify(merge_close(xy, close, degrees), tolerance), 2, degrees)


def gradient_curvature(xy: np.ndarray) -> np.ndarray:
    """Curvature of the coordinates as functions of the vertex number."""
    if len(xy) < 3:
        return np.zeros(len(xy))
    d1 = np.gradient(xy, axis=0)
    d2 = np.gradient(d1, axis=0)
    bottom = (d1**2).sum(axis=1) ** 1.5
    return np.abs(d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]) / np.where(bottom > 0, bottom, 1)


def bspline(xy: np.ndarray, n_out: int, residual: float = 2.0) -> np.ndarray:
    """Cubic least-squares spline over arc length with as few even knots as keep the sum of squared residuals within ``residual``; the ends stay."""
    if len(xy) < 4 or length(xy) == 0:
        return xy
    s = along(xy) / length(xy)
    for inner in range(0, len(xy) - 3):
        knots = np.concatenate(([0.0] * 4, np.linspace(0, 1, inner + 2)[1:-1], [1.0] * 4))
        basis = _cubic_basis(s, knots)
        weights = np.ones(len(xy))
        weights[[0, -1]] = 1e3
        fit, *_ = np.linalg.lstsq(basis * weights[:, None], xy * weights[:, None], rcond=None)
        if ((basis @ fit - xy) ** 2).sum() <= residual:
            break
    out = _cubic_basis(np.linspace(0, 1, n_out), knots) @ fit
    out[[0, -1]] = xy[[0, -1]]
    return out


def _cubic_basis(s: np.ndarray, knots: np.ndarray) -> np.ndarray:
    n = len(knots) - 1
    last = int(np.flatnonzero(np.diff(knots) > 0)[-1])
    b = ((s[:, None] >= knots[:-1]) & (s[:, None] < knots[1:])).astype(float)
    b[s >= knots[-1], last] = 1.0
    for k in range(1, 4):
        left, right = knots[k:-1] - knots[: n - k], knots[k + 1 :] - knots[1 : n - k + 1]
        b = (s[:, None] - knots[: n - k]) / np.where(left > 0, left, 1) * b[:, :-1] * (left > 0) + (knots[k + 1 :] - s[:, None]) / np.where(right > 0, right, 1) * b[:, 1:] * (right > 0)
    return b


def spline_smooth(xy: np.ndarray, tolerance: float = 2.0, residual: float = 2.0, most: float = 4.0) -> np.ndarray:
    """Simplified, then a spline of 15 points per 100 units if it stays within ``most`` of the line."""
    base = simplify(xy, tolerance) if len(xy) >= 4 else xy
    out = bspline(base, int(np.clip(length(base) / 100 * 15, 4, 150)), residual)
    near = max(point_line_distances(out, base).max(), point_line_distances(base, out).max())
    return out if near < most else base


def offset(xy: np.ndarray, d: float) -> np.ndarray:
    """Parallel line at distance ``d`` to the left of its direction, joined by mitres of at most four times that."""
    step = np.diff(xy[keep_distant(xy, 1e-9)], axis=0)
    xy = xy[keep_distant(xy, 1e-9)]
    if len(xy) < 2:
        return xy
    normal = np.stack((-step[:, 1], step[:, 0]), axis=1) / np.hypot(*step.T)[:, None]
    at = np.concatenate((normal[:1], normal[:-1] + normal[1:], normal[-1:]))
    size = np.maximum((at**2).sum(axis=1), 0.25)
    at[1:-1] *= 2 / size[1:-1, None]
    return xy + d * at


def without_sharp(xy: np.ndarray, degrees: float = 120.0) -> np.ndarray:
    """Vertices that turn by at least ``degrees`` between their own neighbours go."""
    keep = np.ones(len(xy), bool)
    if len(xy) > 2:
        keep[1:-1] = turns(xy) < degrees
    return xy[keep]


def without_jitter(xy: np.ndarray, chord: float = 15.0, degrees: float = 60.0, least: float = 50.0) -> np.ndarray:
    """Inner vertices far from the chord of their neighbours that also turn, judged from the last kept one."""
    if len(xy) < 4 or length(xy) < least:
        return xy
    keep = [0]
    for i in range(1, len(xy) - 1):
        ends = np.stack((xy[keep[-1]], xy[i + 1]))
        far = point_line_distances(xy[i : i + 1], ends)[0] > chord
        if not (far and angle(bearings(xy[i + 1] - xy[i]), bearings(xy[i] - xy[keep[-1]])) > degrees):
            keep.append(i)
    return xy[[*keep, len(xy) - 1]]


def clip_to_box(xy: np.ndarray, box: tuple[float, float, float, float], longest: bool = True) -> list[np.ndarray]:
    """Parts of a line inside a box, or only the longest; segments are cut where they leave it."""
    x0, y0, x1, y1 = box
    runs: list[list[np.ndarray]] = []
    for p, q in zip(xy[:-1], xy[1:], strict=True):
        d, lo, hi = q - p, 0.0, 1.0
        for delta, room in ((-d[0], p[0] - x0), (d[0], x1 - p[0]), (-d[1], p[1] - y0), (d[1], y1 - p[1])):
            if delta == 0 and room < 0:
                lo, hi = 1.0, 0.0
            elif delta < 0:
                lo = max(lo, room / delta)
            elif delta > 0:
                hi = min(hi, room / delta)
        if lo >= hi:
            continue
        a, b = p + lo * d, p + hi * d
        if runs and lo == 0.0 and np.array_equal(runs[-1][-1], a):
            runs[-1].append(b)
        else:
            runs.append([a, b])
    parts = [np.array(r) for r in runs]
    return sorted(parts, key=length, reverse=True)[:1] if longest else parts


def series_on(values, n: int) -> list[float] | None:
    """A list of numbers stretched linearly to ``n`` values; as it is if it has as many, null for fewer than two."""
    if values is None or len(values) < 2:
        return None
    return list(values) if len(values) == n else np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(values)), values).tolist()


def values_along(xy: np.ndarray, values, d: np.ndarray, even: bool = False) -> np.ndarray | None:
    """Values at distances along a line: given per vertex (those that are null are bridged), or with ``even`` spread evenly over it."""
    if values is None or not len(values) or not even and len(values) != len(xy):
        return None
    v = np.array([np.nan if x is None else x for x in values], float)
    at = np.linspace(0, length(xy), len(v)) if even else along(xy)
    good = np.isfinite(v)
    return np.interp(d, at[good], v[good]) if good.any() else None
