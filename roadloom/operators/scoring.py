"""Weights of traces and points, quality of edges and selection of candidates, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators.network import degrees


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int | float) else x


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def unit(x) -> Column:
    return clip(x, 0, 1)


def share(x, scale) -> Column:
    """``x`` as a share of ``scale``, at most 1."""
    return unit(_c(x) / F.greatest(_c(scale), F.lit(1e-6)))


# ---- edges: signals from the sums of ``network.edges``; 0.5 where there is nothing to judge


def repeatability(days, least_days: int = 2) -> Column:
    return F.when(_c(days) > 0, unit(_c(days) / float(max(least_days, 1)))).otherwise(0.5)


def speed_consistency(count, mean, variance, cv_max: float = 0.65) -> Column:
    cv = F.sqrt(F.greatest(F.lit(0.0), _c(variance))) / F.greatest(_c(mean), F.lit(1e-6))
    return F.when((_c(count) > 1) & (_c(mean) > 1e-6), unit(1 - cv / cv_max)).otherwise(0.5)


def path_quality(path=0.5, sensor=0.5, construction=0.0) -> Column:
    return unit(0.5 * F.coalesce(_c(path), F.lit(0.5)) + 0.3 * F.coalesce(_c(sensor), F.lit(0.5)) + 0.2 * unit(1 - _c(construction) / 100))


def road_likeness(support, length, degree_u, degree_v, repeat, heading, density_scale: float = 0.35, most_degree: float = 8.0) -> Column:
    density = share(_c(support) / F.greatest(_c(length), F.lit(1e-6)), density_scale)
    return unit(0.35 * density + 0.25 * unit((_c(degree_u) + _c(degree_v)) / most_degree) + 0.20 * _c(repeat) + 0.20 * _c(heading))


def edge_quality(e: DataFrame, lambda_vpd: float = 1.6, beta: float = 6.0, tau: float = 0.45) -> DataFrame:
    """``e`` (support, weighted_support, vpd_support, hpd_support, length, heading_consistency, days, speed_*) plus quality and effective support.

    ``length`` is the distance of the nodes. Degrees count directed edges at either end.
    """
    d = degrees(e)
    e = e.join(d.withColumnsRenamed({"node": "u", "degree": "du"}), "u").join(d.withColumnsRenamed({"node": "v", "degree": "dv"}), "v")
    e = e.withColumn("repeat", repeatability("days")).withColumn("speed_ok", speed_consistency("speed_count", "speed_mean", "speed_var"))
    e = e.withColumn("probe_consistency", unit(0.45 * F.col("heading_consistency") + 0.35 * F.col("repeat") + 0.20 * F.col("speed_ok")))
    e = e.withColumn("vpd_quality", path_quality(construction="construction" if "construction" in e.columns else 0.0))
    e = e.withColumn("road_likeness", road_likeness("weighted_support", "length", "du", "dv", "repeat", "heading_consistency"))
    probe = F.col("hpd_support") * F.col("probe_consistency")
    raw = probe / (probe + lambda_vpd * F.col("vpd_support") * F.col("vpd_quality") + 1e-6)
    e = e.withColumn("w_probe", unit(raw * g.sigmoid(beta * (F.col("road_likeness") - tau)))).withColumn("w_vpd", unit(1 - F.col("w_probe")))
    effective = F.col("weighted_support") * (0.8 + 0.4 * F.greatest("w_probe", "w_vpd")) * (0.35 + 0.65 * F.col("road_likeness"))
    return e.withColumn("effective_support", F.greatest(effective, F.lit(0.0))).drop("repeat", "speed_ok")


# ---- traces and points


def length_factor(length) -> Column:
    return 0.3 + 0.7 / (1 + F.exp(-(_c(length) - 50) / 80))


def density_factor(points, length) -> Column:
    return F.least(F.lit(1.0), _c(points) / F.greatest(_c(length), F.lit(1.0)) * 5.0)


def trace_weight(source, length, points, heading=0.5, path=0.5, sensor=0.5, construction=0.0, vpd: float = 1.2, hpd: float = 1.0) -> Column:
    """Base by source, raised by qualities and lowered by construction, times length, density and agreement of direction; 0.1 to 3."""
    base = F.when(F.upper(_c(source)) == "VPD", vpd).otherwise(hpd) + 0.25 * unit(path) + 0.15 * unit(sensor)
    base = base * F.greatest(F.lit(0.35), 1 - 0.65 * _c(construction) / 100)
    return clip(base * length_factor(length) * (0.4 + 0.3 * density_factor(points, length) + 0.3 * _c(heading)), 0.1, 3.0)


def raster_weight(length, points, heading) -> Column:
    """As ``trace_weight`` without a source, 0.1 to 2; fewer than three points have a neutral direction."""
    density = F.when(_c(length) > 0, F.least(F.lit(1.0), _c(points) / _c(length) * 5.0)).otherwise(0.5)
    return clip(length_factor(length) * (0.4 + 0.3 * density + 0.3 * F.when(_c(points) >= 3, unit(heading)).otherwise(0.5)), 0.1, 2.0)


def point_weight(source, path, sensor, construction, day=None, hour=None, on_day: int | None = None, on_hour: int | None = None, vpd: float = 1.2, hpd: float = 1.0, boost: float = 0.25, penalty: float = 0.65, mismatch: float = 0.5) -> Column:
    """Weight of a trace's points in a slice of time; never under 0.05."""
    w = F.when(F.upper(_c(source)) == "VPD", vpd).otherwise(hpd)
    for value, raised in ((path, boost), (sensor, 0.5 * boost)):
        if value is not None:
            w = w + F.when(_c(value).isNotNull(), raised * unit(value)).otherwise(0.0)
    w = w * F.greatest(F.lit(0.15), 1 - penalty * F.coalesce(_c(construction), F.lit(0.0)) / 100)
    for value, wanted in ((day, on_day), (hour, on_hour)):
        if wanted is not None and value is not None:
            w = w * F.when(_c(value).isNotNull() & (_c(value) != wanted), 1 - mismatch).otherwise(1.0)
    return F.greatest(w, F.lit(0.05))


# ---- selection of candidates


@dataclass(frozen=True)
class Selection:
    """Limits of a selection; the fixed values of the three rule sets are below."""

    force: float
    short: float
    low: float
    dangling_length: float
    dangling_support: float
    length_scale: float
    density_scale: float
    threshold: float
    dangling_factor: float
    connected_floor: float
    weights: tuple[float, float, float, float, float, float]  # support, density, length, connectivity, geometry, likeness


#: Fixed values.
CENTERLINES = Selection(8.0, 5.0, 2.0, 45.0, 3.0, 50.0, 0.15, 0.25, 0.70, 0.55, (0.30, 0.15, 0.30, 0.25, 0.0, 0.0))
CENTERLINES_STRICT = Selection(18.0, 10.0, 5.0, 35.0, 8.0, 70.0, 0.25, 0.52, 0.35, 0.65, (0.30, 0.22, 0.18, 0.20, 0.10, 0.0))
SEGMENTS = Selection(18.0, 10.0, 5.0, 35.0, 8.0, 70.0, 0.25, 0.52, 0.35, 0.65, (0.35, 0.0, 0.20, 0.20, 0.0, 0.25))


def select_candidates(lines: DataFrame, rules: Selection = CENTERLINES, support: str = "weighted_support") -> DataFrame:
    """``lines`` (u, v, length, ends_apart, support) plus degrees, ``selection_score``, ``selection_reason`` and ``is_selected``.

    Strong lines stay; short weak ones and weak dangling ones go; the score decides on the rest.
    """
    d = degrees(lines)
    out = lines.join(d.withColumnsRenamed({"node": "u", "degree": "u_degree"}), "u").join(d.withColumnsRenamed({"node": "v", "degree": "v_degree"}), "v")
    out = out.withColumn("is_dangling", (F.col("u_degree") <= 1) | (F.col("v_degree") <= 1))
    joined = unit((F.col("u_degree") + F.col("v_degree")) / 8.0)
    joined = F.when(F.col("is_dangling"), joined * rules.dangling_factor).otherwise(F.greatest(joined, F.lit(rules.connected_floor)))
    safe = F.greatest(F.col("length"), F.lit(1e-6))
    bent = unit((F.col("length") - F.col("ends_apart")) / safe)
    straight = unit(1 - F.abs(F.col("length") / F.greatest(F.col("ends_apart"), F.lit(1e-6)) - 1.15) / 1.6)
    curved = unit(bent / 0.20)
    parts = (share(support, rules.force), share(F.col(support) / safe, rules.density_scale), share("length", rules.length_scale), joined, F.greatest(0.6 * straight + 0.4 * curved, curved), F.col("road_likeness") if rules.weights[5] else F.lit(0.0))
    score = sum((w * p for w, p in zip(rules.weights, parts, strict=True) if w), F.lit(0.0))
    out = out.withColumn("selection_score", score)
    reason = (
        F.when(F.col(support) >= rules.force, "force_keep_support")
        .when((F.col("length") < rules.short) & (F.col(support) < rules.low), "drop_short_low_support")
        .when(F.col("is_dangling") & (F.col("length") < rules.dangling_length) & (F.col(support) < rules.dangling_support), "drop_dangling_weak")
        .when(F.col("selection_score") >= rules.threshold, "score_threshold")
        .otherwise("drop_low_score")
    )
    return out.withColumn("selection_reason", reason).withColumn("is_selected", ~F.col("selection_reason").startswith("drop"))


def segment_quality(lines: DataFrame) -> DataFrame:
    """``lines`` (id, line, source, support) plus ends as nodes, likeness and effective support by source."""
    key = lambda k: F.concat_ws(",", F.bround(F.element_at("line", k)["x"], 1), F.bround(F.element_at("line", k)["y"], 1))
    e = lines.withColumn("u", key(1)).withColumn("v", key(-1)).withColumn("length", g.line_length("line"))
    e = e.withColumn("ends_apart", g.distance(F.element_at("line", 1)["x"], F.element_at("line", 1)["y"], F.element_at("line", -1)["x"], F.element_at("line", -1)["y"]))
    d = degrees(e)
    e = e.join(d.withColumnsRenamed({"node": "u", "degree": "du"}), "u").join(d.withColumnsRenamed({"node": "v", "degree": "dv"}), "v")
    e = e.withColumn("road_likeness", road_likeness(F.coalesce("support", F.lit(1.0)), "length", "du", "dv", 0.5, F.coalesce("heading_consistency", F.lit(0.5)) if "heading_consistency" in e.columns else 0.5))
    low, high = F.when(F.upper("source") == "VPD", 0.5).otherwise(0.3), F.when(F.upper("source") == "VPD", 0.5).otherwise(0.7)
    return e.withColumn("effective_support", F.coalesce("support", F.lit(1.0)) * (low + high * F.col("road_likeness"))).drop("du", "dv")


def scored_segments(lines: DataFrame) -> DataFrame:
    """``segment_quality`` and the selection of segments by it."""
    return select_candidates(segment_quality(lines), SEGMENTS, "effective_support")


def trial_score(f1, precision, length_ratio, floor: float = 0.9, most_ratio: float = 1.2, precision_penalty: float = 1.5, length_penalty: float = 0.7) -> Column:
    """F1 less squared penalties for precision under a floor and for too much length."""
    p, r = F.greatest(F.lit(0.0), floor - _c(precision)), F.greatest(F.lit(0.0), _c(length_ratio) - most_ratio)
    return _c(f1) - precision_penalty * p * p - length_penalty * r * r


def trial_table(trials: DataFrame) -> DataFrame:
    """Trials by falling objective, then F1; failed ones (null) last."""
    return trials.orderBy(F.desc_nulls_last("objective"), F.desc_nulls_last("f1"))
