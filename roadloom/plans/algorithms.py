"""Algorithms that make a network from traces, by name, with their settings; others can be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import centerlines, clustering, network, refine, roundabouts, scoring
from roadloom.session import cut

REGISTRY: dict[str, tuple[type, Callable[..., Result]]] = {}


@dataclass
class Result:
    """Nodes, edges and centerlines of a run, and what it was run with."""

    nodes: DataFrame
    edges: DataFrame
    centerlines: DataFrame
    settings: dict = field(default_factory=dict)


def algorithm(name: str, settings: type):
    """Registers a function of points, lines and settings."""

    def put(f):
        if name in REGISTRY:
            raise ValueError(f"there is an algorithm {name}")
        REGISTRY[name] = (settings, f)
        return f

    return put


def available() -> list[str]:
    return sorted(REGISTRY)


def settings_of(name: str, **given) -> object:
    """Settings of an algorithm with some replaced; unknown names are errors."""
    if name not in REGISTRY:
        raise ValueError(f"no algorithm {name}; there are {', '.join(available())}")
    kind = REGISTRY[name][0]
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{name} has no settings {sorted(unknown)}")
    return replace(kind(), **given)


def generate(name: str, points: DataFrame, lines: DataFrame, **given) -> Result:
    """Runs an algorithm on points (``trace_id, pos, x, y, ...``) and the lines (``trace_id, line``) they make."""
    settings = settings_of(name, **given)
    out = REGISTRY[name][1](points, lines, settings)
    out.settings = {"algorithm": name, **asdict(settings)}
    return out


@dataclass(frozen=True)
class CellSettings:
    cell: float = 30.0
    most_step: float = 50.0
    least_support: int = 2
    reverse_ratio: float = 0.2
    detour: float = 1.2
    hops: int = 4
    shortest: float = 6.0
    select: bool = True


@algorithm("cells", CellSettings)
def cells(points: DataFrame, lines: DataFrame, s: CellSettings) -> Result:
    """Transitions between cells, pruned, stitched to centerlines and selected."""
    labelled = network.labelled(points, s.cell)
    strong = cut(network.prune_weak(network.edges(network.transitions(labelled, s.most_step)), s.least_support, s.reverse_ratio))
    e = cut(network.prune_transitive(strong, s.detour, s.hops))
    nodes = network.nodes(labelled)
    c = centerlines.centerlines(e, nodes, s.shortest)
    if s.select:
        c = scoring.select_candidates(c).where("is_selected")
    return Result(nodes, e, c)


@dataclass(frozen=True)
class WindowSettings:
    centre: float = 35.0
    degrees: float = 30.0
    most: float = 16.0
    members: int = 3
    support: float = 5.5


@algorithm("windows", WindowSettings)
def windows(points: DataFrame, lines: DataFrame, s: WindowSettings) -> Result:
    """Windows of traces grouped by course; vertices and links of their representatives."""
    nodes, e = clustering.network_of(lines.withColumnRenamed("trace_id", "id"), centre=s.centre, degrees=s.degrees, most=s.most, members=s.members, support=s.support)
    return Result(nodes, e, e.withColumn("ends_apart", F.lit(None).cast("double")))


@dataclass(frozen=True)
class SkeletonSettings:
    pixel: float = 5.0
    share: float = 0.15
    shortest: float = 20.0


@algorithm("skeleton", SkeletonSettings)
def skeleton(points: DataFrame, lines: DataFrame, s: SkeletonSettings) -> Result:
    """Thinned density of points."""
    px = clustering.skeleton(points, s.pixel, share=s.share)
    c = clustering.skeleton_lines(px, s.pixel, s.shortest)
    return Result(px, c, c)


def full_network(points: DataFrame, lines: DataFrame, **given) -> DataFrame:
    """All phases: centerlines from cells, roundabouts drawn in, refined."""
    made = generate("cells", points, lines, **given)
    net = made.centerlines.select(F.col("path").alias("id"), "line", F.lit("VPD").alias("source"), F.col("weighted_support").alias("support"))
    rings = roundabouts.detect(lines.withColumnRenamed("trace_id", "id"))
    return refine.refined(roundabouts.with_roundabouts(net, rings))
