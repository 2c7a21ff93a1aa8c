"""Column functions over planar points and lines (``array<struct<x:double,y:double>>``); no Python runs per row.

Angles are degrees. ``bearing`` counts clockwise from north, ``bearing_east`` counter-clockwise from east.
Null in gives null out; lines of fewer than two points have length 0 and no heading.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x2) - _c(x1), _c(y2) - _c(y1))


def half_away(c, digits: int) -> Column:
    """Rounded as DuckDB rounds doubles: scaled, halves of the scaled value away from zero. Spark's ``round`` goes by the decimal text instead."""
    m = 10.0**digits
    v = _c(c) * m
    return F.signum(v) * F.floor(F.abs(v) + 0.5) / m


def bearing(x1, y1, x2, y2) -> Column:
    return F.pmod(F.degrees(F.atan2(_c(x2) - _c(x1), _c(y2) - _c(y1))) + 360, F.lit(360.0))


def bearing_east(x1, y1, x2, y2) -> Column:
    return F.pmod(F.degrees(F.atan2(_c(y2) - _c(y1), _c(x2) - _c(x1))) + 360, F.lit(360.0))


def angle_difference(a, b) -> Column:
    """Smallest difference of two directions, 0 to 180."""
    return F.abs(F.pmod(_c(a) - _c(b) + 180, F.lit(360.0)) - 180)


def axis_difference(a, b) -> Column:
    """Smallest difference of two undirected headings, 0 to 90."""
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(180.0))
    return F.least(d, 180 - d)


def compass(heading) -> Column:
    """Eight-way name of a heading; UNKNOWN for null."""
    k = (F.floor((_c(heading) + 22.5) / 45) % 8).cast("int")
    return F.coalesce(F.element_at(F.array(*map(F.lit, COMPASS)), k + 1), F.lit("UNKNOWN"))


def axis_name(heading) -> Column:
    """Two-way name: north-south or east-west."""
    h = _c(heading)
    return F.when(h.isNull(), "UNKNOWN").when((h >= 315) | (h < 45) | ((h >= 135) & (h < 225)), "N_S").otherwise("E_W")


def circular_mean(heading, weight=None) -> Column:
    """Aggregate: weighted mean direction in [0, 360)."""
    w = _c(weight) if weight is not None else F.lit(1.0)
    r = F.radians(_c(heading))
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(r) * w), F.sum(F.cos(r) * w))) + 360, F.lit(360.0))


def concentration(heading) -> Column:
    """Aggregate: mean resultant length, 1 if all directions agree."""
    r = F.radians(_c(heading))
    return F.hypot(F.avg(F.sin(r)), F.avg(F.cos(r)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(_c(x), F.lit(35.0)), F.lit(-35.0))))


def line_length(line: str) -> Column:
    return F.expr(f"aggregate(sequence(2, greatest(2, size({line}))), 0D, (a, i) -> a + coalesce(hypot(get({line}, i - 1).x - {line}[i - 2].x, get({line}, i - 1).y - {line}[i - 2].y), 0D))")


def cumulative(line: str) -> Column:
    """Distance along the line at every vertex."""
    step = f"hypot({line}[i].x - {line}[i - 1].x, {line}[i].y - {line}[i - 1].y)"
    return F.expr(f"aggregate(sequence(0, size({line}) - 1), cast(array() AS array<double>), (a, i) -> concat(a, array(CASE WHEN i = 0 THEN 0D ELSE element_at(a, -1) + {step} END)))")


def start_end_heading(line: str) -> Column:
    return F.expr(f"CASE WHEN size({line}) >= 2 THEN pmod(degrees(atan2(element_at({line}, -1).x - {line}[0].x, element_at({line}, -1).y - {line}[0].y)) + 360, 360D) END")


def _at(line: str, cum: str, d: str) -> str:
    """SQL of the point at distance ``d`` along a line with cumulative lengths ``cum``."""
    k = f"greatest(1, least(size({cum}) - 1, size(filter({cum}, c -> c <= {d}))))"
    t = f"coalesce(({d} - {cum}[{k} - 1]) / nullif({cum}[{k}] - {cum}[{k} - 1], 0D), 0D)"
    return f"struct({line}[{k} - 1].x + ({line}[{k}].x - {line}[{k} - 1].x) * {t} AS x, {line}[{k} - 1].y + ({line}[{k}].y - {line}[{k} - 1].y) * {t} AS y)"


def resample(line: str, cum: str, n: str) -> Column:
    """``n`` points evenly spaced by arc length; fewer than three give the two ends."""
    return F.expr(f"CASE WHEN size({line}) < 2 THEN {line} WHEN {n} <= 2 THEN array({line}[0], element_at({line}, -1)) ELSE transform(sequence(0, {n} - 1), j -> {_at(line, cum, f'(element_at({cum}, -1) * j / ({n} - 1))')}) END")


def densify(line: str, cum: str, step: float) -> Column:
    """Equal parts of at most ``step``; inner vertices of the line are not kept."""
    return resample(line, cum, f"cast(greatest(1D, ceil(element_at({cum}, -1) / {float(step)})) + 1 AS int)")


def bounds(line: str) -> Column:
    return F.expr(
        f"struct(array_min(transform({line}, p -> p.x)) AS x0, array_min(transform({line}, p -> p.y)) AS y0, array_max(transform({line}, p -> p.x)) AS x1, array_max(transform({line}, p -> p.y)) AS y1)"
    )


def any_vertex_in(line: str, box: tuple[float, float, float, float]) -> Column:
    a, b, c, d = map(float, box)
    return F.expr(f"exists({line}, p -> p.x BETWEEN {a}D AND {c}D AND p.y BETWEEN {b}D AND {d}D)")


def snap(line: str, grid: float) -> Column:
    """Coordinates rounded half to even on a grid."""
    g = float(grid)
    return F.expr(f"transform({line}, p -> struct(bround(p.x / {g}D) * {g}D AS x, bround(p.y / {g}D) * {g}D AS y))")


def smooth(line: str, weight: float = 0.2) -> Column:
    """One pass of a three-point kernel; the ends stay."""
    w = float(weight)
    mid = lambda c: f"{w}D * {line}[i - 1].{c} + {1 - 2 * w}D * p.{c} + {w}D * {line}[i + 1].{c}"
    return F.expr(f"transform({line}, (p, i) -> CASE WHEN i = 0 OR i = size({line}) - 1 THEN p ELSE struct({mid('x')} AS x, {mid('y')} AS y) END)")


def turn_at(line: str) -> str:
    """SQL lambda of the turn in degrees at inner vertex ``i``."""
    a = f"degrees(atan2({line}[i].x - {line}[i - 1].x, {line}[i].y - {line}[i - 1].y))"
    b = f"degrees(atan2({line}[i + 1].x - {line}[i].x, {line}[i + 1].y - {line}[i].y))"
    return f"abs(pmod({b} - {a} + 180D, 360D) - 180D)"


def turn_indices(line: str, degrees: float) -> Column:
    """Both ends and every vertex that turns by at least ``degrees``."""
    return F.expr(f"filter(sequence(0, size({line}) - 1), i -> i = 0 OR i = size({line}) - 1 OR {turn_at(line)} >= {float(degrees)}D)")


def smooth_keeping_turns(line: str, degrees: float = 35.0, weight: float = 0.2) -> Column:
    """As ``smooth``, but vertices that turn by at least ``degrees`` stay as well."""
    w = float(weight)
    mid = lambda c: f"{w}D * {line}[i - 1].{c} + {1 - 2 * w}D * p.{c} + {w}D * {line}[i + 1].{c}"
    return F.expr(f"transform({line}, (p, i) -> CASE WHEN i = 0 OR i = size({line}) - 1 OR {turn_at(line)} >= {float(degrees)}D THEN p ELSE struct({mid('x')} AS x, {mid('y')} AS y) END)")


def chaikin(line: str) -> Column:
    """One round of corner cutting; the ends stay."""
    q = lambda a, b: f"struct({a}D * {line}[i].x + {b}D * {line}[i + 1].x AS x, {a}D * {line}[i].y + {b}D * {line}[i + 1].y AS y)"
    return F.expr(f"CASE WHEN size({line}) < 3 THEN {line} ELSE concat(array({line}[0]), flatten(transform(sequence(0, size({line}) - 2), i -> array({q(0.75, 0.25)}, {q(0.25, 0.75)}))), array(element_at({line}, -1))) END")


def menger(x1, y1, x2, y2, x3, y3) -> Column:
    """Curvature of the circle through three points; 0 where a side is under 0.1."""
    a, b, c = distance(x1, y1, x2, y2), distance(x2, y2, x3, y3), distance(x1, y1, x3, y3)
    area = F.abs((_c(x2) - _c(x1)) * (_c(y3) - _c(y1)) - (_c(x3) - _c(x1)) * (_c(y2) - _c(y1))) / 2
    return F.when(F.least(a, b, c) < 0.1, 0.0).otherwise(4 * area / (a * b * c))


def circumcircle(x1, y1, x2, y2, x3, y3) -> Column:
    """Centre and radius of the circle through three points; null where they are in line."""
    x1, y1, x2, y2, x3, y3 = map(_c, (x1, y1, x2, y2, x3, y3))
    d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
    s1, s2, s3 = x1 * x1 + y1 * y1, x2 * x2 + y2 * y2, x3 * x3 + y3 * y3
    cx = (s1 * (y2 - y3) + s2 * (y3 - y1) + s3 * (y1 - y2)) / d
    cy = (s1 * (x3 - x2) + s2 * (x1 - x3) + s3 * (x2 - x1)) / d
    return F.when(F.abs(d) >= 1e-10, F.struct(cx.alias("x"), cy.alias("y"), F.hypot(x1 - cx, y1 - cy).alias("r")))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(0.0)
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def sinuosity(line: str) -> Column:
    """Length over the distance of the ends; null where the ends meet."""
    return line_length(line) / F.expr(f"nullif(hypot(element_at({line}, -1).x - {line}[0].x, element_at({line}, -1).y - {line}[0].y), 0D)")


def cosine(ax, ay, bx, by) -> Column:
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    n = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(n > 0, (ax * bx + ay * by) / n).otherwise(0.0)


def parse_wkt(text) -> Column:
    """Lines of a LINESTRING or MULTILINESTRING; bad or empty text gives none, bad points spoil their line."""
    clean = F.upper(F.trim(_c(text)))
    body = F.regexp_extract(clean, r"^(?:MULTI)?LINESTRING\s*(?:Z\s*)?\((.*)\)$", 1)
    body = F.when(clean.startswith("MULTI"), body).otherwise(F.concat(F.lit("("), body, F.lit(")")))
    parts = F.regexp_extract_all(body, F.lit(r"\(([^()]+)\)"), 1)

    def point(p: Column) -> Column:
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(F.try_element_at(xy, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(xy, F.lit(2)).try_cast("double").alias("y"))

    lines = F.transform(parts, lambda s: F.transform(F.split(s, ","), point))
    return F.filter(F.coalesce(lines, F.array().cast(f"array<{POINTS}>")), lambda ln: (F.size(ln) >= 2) & ~F.exists(ln, lambda p: p["x"].isNull() | p["y"].isNull()))


def to_wkt(line: str, digits: int = 6) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.expr(f"transform({line}, p -> concat(cast(round(p.x, {digits}) AS string), ' ', cast(round(p.y, {digits}) AS string)))"), ", "), F.lit(")"))


def parse_numbers(text) -> Column:
    """Numbers of a list literal, quotes of either kind allowed; anything else gives an empty list."""
    return F.coalesce(F.from_json(F.translate(_c(text), "'\"", ""), "array<double>"), F.array().cast("array<double>"))


def flag(text) -> Column:
    """True for yes, true and 1 in any case and spacing; null is false."""
    return F.coalesce(F.lower(F.trim(_c(text).cast("string"))).isin("yes", "true", "1"), F.lit(False))


def utm(lon, lat, zone: int = 34) -> Column:
    """Easting and northing on WGS 84 by the transverse Mercator series of order n^3 (northern hemisphere)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    e = 2 * n**0.5 / (1 + n)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(alpha, 1)), F.lit(0.0))
    return F.struct((500000 + 0.9996 * big * east).alias("x"), (0.9996 * big * north).alias("y"))
