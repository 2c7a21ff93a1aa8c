"""Registered queries of whole networks: lines, centerlines, refinement, topology, clusters and scores against the true roads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators import carriageways, centerlines, checks, clustering, network, overlay, refine, roundabouts, scores, scoring, spatial, topology, windows
from roadloom.operators import lines as ln
from roadloom.plans import algorithms
from roadloom.plans.queries import query, r6, scored_edges
from roadloom.session import cut, stored
from roadloom.sources import maps, traces


def shape(d: DataFrame, *columns: str) -> DataFrame:
    """Lines as their length, number of points and ends, which tables of results can hold."""
    at = lambda k, c: F.round(F.element_at("line", k)[c], 4)
    return d.select(*columns, F.round(g.line_length("line"), 4).alias("length"), F.size("line").alias("points"), at(1, "x").alias("x1"), at(1, "y").alias("y1"), at(-1, "x").alias("x2"), at(-1, "y").alias("y2"))


def paths(p: DataFrame) -> DataFrame:
    return traces.lines(p).withColumnRenamed("trace_id", "id")


def roads(p: DataFrame) -> DataFrame:
    return traces.grid_roads(p.sparkSession)


def graph(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pruned edges and nodes of the road graph."""
    d = network.labelled(p)
    return cut(network.prune_weak(network.edges(network.transitions(d)), 1, 0.2)), network.nodes(d)


def made(p: DataFrame) -> DataFrame:
    """Centerlines as a network."""
    e, n = graph(p)
    c = centerlines.centerlines(e, n)
    return cut(c.select(F.shiftright("path", 3).alias("id"), "line", F.lit("VPD").alias("source"), F.col("weighted_support").alias("support")))


def with_height(net: DataFrame) -> DataFrame:
    return net.withColumn("z", F.lit(None).cast("double"))


# ---- lines


@query("line_parts")
def line_parts(p: DataFrame) -> DataFrame:
    return shape(windows.substrings(traces.lines(p), 100.0), "trace_id", "part")


@query("turn_parts")
def turn_parts(p: DataFrame) -> DataFrame:
    return shape(windows.turn_parts(traces.lines(p), 60.0, 10.0), "trace_id", "part")


@query("distance_windows")
def distance_windows(p: DataFrame) -> DataFrame:
    return shape(windows.windows_by_distance(traces.lines(p)), "trace_id", "win")


@query("clipped_lines")
def clipped_lines(p: DataFrame) -> DataFrame:
    return shape(maps.clipped(paths(p), (100.0, 100.0, 900.0, 700.0), longest=False), "id")


@query("curved_sections")
def curved_sections(p: DataFrame) -> DataFrame:
    return ln.per_line(paths(p), lambda xy: ln.curved_sections(xy, 0.02), "first int, last int")


@query("arc_runs")
def arc_runs(p: DataFrame) -> DataFrame:
    d = ln.per_line(paths(p), lambda xy: ln.arc_runs(xy, 20.0), "first int, last int, turned double")
    return d.withColumn("turned", F.round("turned", 4))


def _kernel_query(name: str, kernel) -> None:
    @query(name)
    def run(p: DataFrame) -> DataFrame:
        return shape(ln.per_line(paths(p), lambda xy: [(kernel(xy),)], f"line {ln.LINE}"), "id")


_kernel_query("smoothed_keeping_turns", lambda xy: ln.smooth_keeping_turns(xy, 3, 45.0, 0.2))
_kernel_query("smoothed_once", lambda xy: ln.smooth_keeping_turns(xy, 3, 45.0, 0.2, once=True))
_kernel_query("corner_cut", lambda xy: ln.chaikin(xy, 2))
_kernel_query("corner_cut_inner", lambda xy: ln.chaikin(xy, 2, skip_first=True))
_kernel_query("simplified_and_smoothed", ln.simplify_and_smooth)
_kernel_query("spline_lines", ln.spline_smooth)
_kernel_query("offset_lines", lambda xy: ln.offset(xy, 3.0))
_kernel_query("resampled_lines", lambda xy: ln.at_distance(xy, ln.step_points(xy, 25.0)))


@query("interpolated_values")
def interpolated_values(p: DataFrame) -> DataFrame:
    """Heights at places every 25 along a line, given per vertex or spread over it."""
    d = windows.trace_arrays(p, "altitude")

    def kernel(xy, z):
        at = ln.step_points(xy, 25.0)
        for k, (a, b) in enumerate(zip(ln.values_along(xy, z, at), ln.values_along(xy, z, at, even=True), strict=True)):
            yield k, round(float(a), 6), round(float(b), 6)

    return ln.per_line(d, kernel, "k int, by_vertex double, by_length double", also=("altitude",), drop=("altitude",))


# ---- lines against roads

#: The true roads, straight along an axis.
_ROADS = """rd AS (SELECT id, id < 10 AS flat, CAST(60 AS DOUBLE) * (id % 10) AS at_ FROM (SELECT unnest(range(20)) AS id))"""


@query("roads_within")
def roads_within(p: DataFrame) -> DataFrame:
    return overlay.within(paths(p), roads(p), 1.0).select("a", "b", r6("dist"))


@query("covered_length")
def covered_length(p: DataFrame) -> DataFrame:
    return overlay.length_within(paths(p), roads(p), 2.0).select("id", r6("total"), r6("inside_length"))


@query("uncovered_stretches")
def uncovered_stretches(p: DataFrame) -> DataFrame:
    return overlay.uncovered_stretches(roads(p), paths(p), 5.0, 1.0).select("id", "part", r6("lo"), r6("hi"))


@query("new_road_lines")
def new_road_lines(p: DataFrame) -> DataFrame:
    return shape(maps.new_in(roads(p), paths(p), 5.0), "id", "part")


@query(
    "nearest_road",
    f"{_ROADS}, d AS (SELECT event_id, id, CASE WHEN flat THEN sqrt(pow(y - at_, 2) + pow(greatest(0, -x, x - 1200), 2)) ELSE sqrt(pow(x - at_, 2) + pow(greatest(0, -y, y - 1200), 2)) END AS dist FROM pts, rd) SELECT event_id, arg_min(id, (round(dist, 9), id)) AS road, round(min(dist), 6) AS dist FROM d WHERE dist <= 20 GROUP BY event_id",
)
def nearest_road(p: DataFrame) -> DataFrame:
    d = overlay.nearest_on_lines(p.select(F.col("event_id").alias("pid"), "x", "y"), roads(p), 20.0, k=20).withColumn("near", F.round("dist", 9))
    return d.groupBy(F.col("pid").alias("event_id")).agg(F.min(F.struct("near", "id")).alias("m"), F.min("dist").alias("dist")).select("event_id", F.col("m.id").alias("road"), r6("dist"))


@query("mean_distances")
def mean_distances(p: DataFrame) -> DataFrame:
    pairs = overlay.within(paths(p), roads(p), 3.0).select("a", "b")
    return overlay.mean_distance(paths(p), roads(p), pairs, 10.0).select("a", "b", r6("mean_dist"))


@query("gap_lines")
def gap_lines(p: DataFrame) -> DataFrame:
    gaps = maps.new_in(paths(p), roads(p), 1.5).withColumn("id", F.xxhash64("id", "part")).select("id", "line")
    return shape(clustering.gap_lines(stored(gaps), shortest=2.0), "id", "support")


# ---- centerlines


@query("stitched_paths")
def stitched_paths(p: DataFrame) -> DataFrame:
    return centerlines.chains(graph(p)[0])


@query("greedy_paths")
def greedy_paths(p: DataFrame) -> DataFrame:
    return centerlines.greedy_paths(graph(p)[0])


@query("path_statistics")
def path_statistics(p: DataFrame) -> DataFrame:
    e, _ = graph(p)
    d = centerlines.path_statistics(centerlines.chains(e), e)
    return d.select("path", "support", "fw", "rv", "vpd_support", "hpd_support", r6("mean_speed"), r6("heading_consistency"), "dir_travel")


@query("centerlines")
def centerline_rows(p: DataFrame) -> DataFrame:
    return shape(centerlines.centerlines(*graph(p)), "path", "u", "v", "support", "dir_travel")


@query("selected_centerlines")
def selected_centerlines(p: DataFrame) -> DataFrame:
    return scoring.select_candidates(centerlines.centerlines(*graph(p))).select("path", r6("selection_score"), "selection_reason", "is_selected")


@query("strictly_selected_centerlines")
def strictly_selected_centerlines(p: DataFrame) -> DataFrame:
    return scoring.select_candidates(centerlines.centerlines(*graph(p)), scoring.CENTERLINES_STRICT).select("path", r6("selection_score"), "selection_reason", "is_selected")


@query("selected_segments")
def selected_segments(p: DataFrame) -> DataFrame:
    return scoring.scored_segments(made(p)).select("id", r6("road_likeness"), r6("effective_support"), r6("selection_score"), "selection_reason")


@query("shaped_edges")
def shaped_edges(p: DataFrame) -> DataFrame:
    m = network.transitions(network.labelled(p))
    e = scored_edges(p).select("u", "v", "x1", "y1", "x2", "y2")
    both = m.select("u", "v", "x", "y").unionByName(m.select("u", "v", F.col("px").alias("x"), F.col("py").alias("y")))
    return shape(centerlines.shaped_edges(e, both), "u", "v")


@query("height_levels")
def height_levels(p: DataFrame) -> DataFrame:
    d = centerlines.levels(network.labelled(p).select("node", F.col("altitude").alias("z")), "node")
    return d.groupBy("node", "level").agg(F.count("*").alias("n"))


# ---- refinement


def _refinement(name: str, step) -> None:
    @query(name)
    def run(p: DataFrame) -> DataFrame:
        return shape(step(made(p)), "id")


_refinement("without_spurs", refine.without_spurs)
_refinement("without_parallel", refine.without_parallel)
_refinement("without_parallel_wide", lambda net: refine.without_parallel(net, 10.0, 25.0, 0.65, 0.3, 0.85, 0.8))
_refinement("without_sharp_vertices", refine.without_sharp_vertices)
_refinement("smoothed_network", refine.smoothed)
_refinement("snapped_ends", refine.snapped_ends)
_refinement("stitched_fragments", refine.stitched)
_refinement("bridged_dead_ends", refine.bridged)
_refinement("without_jitter", refine.without_jitter)
_refinement("without_loops", refine.without_loops)
_refinement("without_stubs", refine.without_stubs)
_refinement("interchange_cleaned", refine.interchange_cleaned)
_refinement("quality_selected", refine.quality_selected)
_refinement("refined_network", refine.refined)


@query("end_intersections")
def end_intersections(p: DataFrame) -> DataFrame:
    return refine.intersections(made(p)).select("node", r6("x"), r6("y"), "degree")


@query("crossing_levels")
def crossing_levels(p: DataFrame) -> DataFrame:
    return refine.with_levels(paths(p)).select("id", "z_level")


# ---- topology


@query("junction_nodes")
def junction_nodes(p: DataFrame) -> DataFrame:
    return topology.junction_nodes(paths(p)).select("node", r6("x"), r6("y"), "degree", "kind")


@query("end_headings")
def end_headings(p: DataFrame) -> DataFrame:
    return topology.end_headings(paths(p)).select("id", "end", r6("heading"))


@query("noded_roads")
def noded_roads(p: DataFrame) -> DataFrame:
    return shape(topology.noded(roads(p).select("id", "line")), "id", "part")


@query("split_roads")
def split_roads(p: DataFrame) -> DataFrame:
    net = roads(p).select("id", "line")
    return shape(topology.split_at_nodes(net, cut(topology.junction_nodes(net))), "id", "part")


@query("topology_edges")
def topology_edges(p: DataFrame) -> DataFrame:
    _, e = topology.deduplicated(with_height(made(p)))
    return shape(e, "from_node", "to_node", "support", "members")


@query("rounded_graph")
def rounded_graph(p: DataFrame) -> DataFrame:
    e = topology.rounded_graph(made(p))
    return e.select(*(F.col(f"{n}.{c}").alias(n + c) for n in "uv" for c in "xy"), r6("length"))


# ---- roundabouts and double lines


@query("roundabout_candidates")
def roundabout_candidates(p: DataFrame) -> DataFrame:
    """The traces' wiggles make arcs; a loosened limit shows how candidates are judged."""
    c = roundabouts.candidates(roundabouts.arcs(paths(p), turn=30.0, spread=0.6, box=1.0))
    return c.select(r6("x"), r6("y"), r6("r"), "traces", "arcs", "directions")


@query("parallel_pairs")
def parallel_pairs(p: DataFrame) -> DataFrame:
    return carriageways.parallel_pairs(paths(p)).select("a", "b", r6("mean_dist"))


@query("single_lines")
def single_lines(p: DataFrame) -> DataFrame:
    return shape(carriageways.single_lines(paths(p)), "id")


@query("opposite_pairs")
def opposite_pairs(p: DataFrame) -> DataFrame:
    return carriageways.opposite_pairs(paths(p)).select("a", "b", r6("mean_dist"))


@query("without_opposites")
def without_opposites(p: DataFrame) -> DataFrame:
    return shape(carriageways.without_opposites(paths(p)), "id")


@query("cleaned_with_intersections")
def cleaned_with_intersections(p: DataFrame) -> DataFrame:
    net = paths(p)
    at = cut(topology.junction_nodes(roads(p).select("id", "line")).withColumn("confidence", F.lit(1.0)))
    return shape(carriageways.cleaned(net, at), "id")


@query("road_directions")
def road_directions(p: DataFrame) -> DataFrame:
    d = carriageways.spatial_groups(paths(p)).join(paths(p).select("id", g.start_end_heading("line").alias("azimuth")), "id")
    return d.groupBy("component").agg(F.count("*").alias("n"), carriageways.road_direction("azimuth").alias("kind"), F.count_distinct(carriageways.direction_bin("azimuth")).alias("bins"))


# ---- clusters


@query("density_clusters")
def density_clusters(p: DataFrame) -> DataFrame:
    c = clustering.density_clusters(p.select(F.col("event_id").alias("id"), "x", "y"), 3.0, 4)
    return c.groupBy("cluster").agg(F.count("*").alias("n"))


@query("density_lines")
def density_lines(p: DataFrame) -> DataFrame:
    d = windows.forward_headings(p).where("heading IS NOT NULL").select(F.col("event_id").alias("id"), "x", "y", "heading")
    return shape(clustering.cluster_polylines(d, 6.0, 4), "id", "support")


@query("trace_clusters")
def trace_clusters(p: DataFrame) -> DataFrame:
    return shape(clustering.trace_clusters(paths(p), 40.0), "id", "members")


@query("greedy_cover")
def greedy_cover(p: DataFrame) -> DataFrame:
    return shape(clustering.greedy_cover(paths(p), 40.0), "id")


@query("window_network")
def window_network(p: DataFrame) -> DataFrame:
    return shape(clustering.network_of(paths(p), members=2, support=2.0)[1], "u", "v", "support")


@query("skeleton_lines")
def skeleton_lines(p: DataFrame) -> DataFrame:
    return shape(clustering.skeleton_lines(cut(clustering.skeleton(p)), 5.0), "id")


@query("registered_algorithm")
def registered_algorithm(p: DataFrame) -> DataFrame:
    return shape(algorithms.generate("cells", p, traces.lines(p), least_support=1).centerlines, "path", "support")


# ---- scores


@query("segmented_score")
def segmented_score(p: DataFrame) -> DataFrame:
    return scores.touching_score(paths(p), roads(p)).select("precision", "recall", "f1")


@query("whole_line_score")
def whole_line_score(p: DataFrame) -> DataFrame:
    return scores.touching_score(paths(p), roads(p), 15.0, None).select("precision", "recall", "f1")


@query("self_score")
def self_score(p: DataFrame) -> DataFrame:
    """The map against itself: 100 and 1 throughout."""
    a, b = scores.touching_score(roads(p), roads(p)), scores.buffer_score(roads(p), roads(p))
    return scores.side_by_side(a.select("precision", "recall"), b.select(F.round("f1", 6).alias("f1")))


@query("buffer_score")
def buffer_score(p: DataFrame) -> DataFrame:
    return scores.buffer_score(paths(p), roads(p), 2.0).select(*(r6(c) for c in ("precision", "recall", "f1", "length_ratio")))


@query("recovery_by_class")
def recovery_by_class(p: DataFrame) -> DataFrame:
    return scores.recovery_by_class(roads(p), paths(p), r=2.0).select("func_class", r6("length"), r6("recovered"), r6("recall"))


@query("uncovered_buckets")
def uncovered_buckets(p: DataFrame) -> DataFrame:
    return scores.uncovered_buckets(roads(p), paths(p), 1.0)


@query("redundancy")
def redundancy(p: DataFrame) -> DataFrame:
    return scores.redundancy(paths(p)).select(r6("length"), r6("redundant"), r6("share"))


@query("overlap_statistics")
def overlap_statistics(p: DataFrame) -> DataFrame:
    return scores.overlap_statistics(paths(p), roads(p)).select(*(r6(c) for c in ("covered_km", "total_km", "covered_pct", "new_km")))


@query("sample_distances")
def sample_distances(p: DataFrame) -> DataFrame:
    d = scores.distance_statistics(cut(scores.samples(paths(p))), cut(scores.samples(roads(p))))
    return d.select("n", *(r6(c) for c in ("mean", "median", "p90", "p95", "rmse")))


@query("matched_samples")
def matched_samples(p: DataFrame) -> DataFrame:
    return scores.matched_points(cut(scores.samples(paths(p))), cut(scores.samples(roads(p)))).select("radius", "matched", *(r6(c) for c in ("precision", "recall", "f1")))


@query("degree_divergence")
def degree_divergence(p: DataFrame) -> DataFrame:
    a, b = scores.graph_nodes(made(p)), scores.graph_nodes(topology.noded(roads(p).select("id", "line")))
    return scores.degree_divergence(a, b).select(r6("js"), r6("similarity"))


@query("path_similarity")
def path_similarity(p: DataFrame) -> DataFrame:
    truth = cut(topology.noded(roads(p).select("id", "line")))
    return scores.path_similarity(truth, truth, 5).select("pairs", r6("apls"))


@query("edit_distance")
def edit_distance(p: DataFrame) -> DataFrame:
    return scores.relative_edit_distance(made(p), topology.noded(roads(p).select("id", "line"))).select("net_nodes", "truth_nodes", r6("ged"))


@query("link_distances")
def link_distances(p: DataFrame) -> DataFrame:
    return scores.link_distances(roads(p), paths(p)).select("id", r6("hausdorff"))


@query("hausdorff_summary")
def hausdorff_summary(p: DataFrame) -> DataFrame:
    return scores.hausdorff_summary(paths(p), roads(p)).select("n", *(r6(c) for c in ("mean", "median", "p90", "p95")))


@query("smoothness")
def smoothness(p: DataFrame) -> DataFrame:
    return scores.side_by_side(scores.smoothness(paths(p)), scores.curvature_smoothness(paths(p))).select(*(r6(c) for c in ("mean", "median", "continuity", "smoothness")))


@query("lane_widths")
def lane_widths(p: DataFrame) -> DataFrame:
    return carriageways.lane_widths(paths(p)).select("pairs", *(r6(c) for c in ("mean", "std", "deviation")))


@query("connectivity_gaps")
def connectivity_gaps(p: DataFrame) -> DataFrame:
    return scores.connectivity(made(p))


@query("step_losses")
def step_losses(p: DataFrame) -> DataFrame:
    net = made(p)
    return scores.step_losses(net, refine.without_parallel(net, 40.0), roads(p)).select("lines", *(r6(c) for c in ("removed_km", "lost_km", "cleared_km")))


@query("score_by_source")
def score_by_source(p: DataFrame) -> DataFrame:
    net = refine.bridged(made(p))
    return scores.by_source(net, roads(p)).select("source", "lines", r6("length"), r6("precision"))


@query("evaluation")
def evaluation(p: DataFrame) -> DataFrame:
    return scores.report(scores.evaluate(topology.noded(roads(p).select("id", "line")), roads(p)))


@query("input_checks")
def input_checks(p: DataFrame) -> DataFrame:
    vpd = traces.lines(p.where("source = 'VPD'")).withColumn("fused", F.lit("Yes"))
    hpd = traces.lines(p.where("source = 'HPD'")).withColumn("point_count", F.size("line"))
    return checks.run_all(vpd, hpd, roads(p), (0.0, 0.0, 1200.0, 1200.0), dict.fromkeys(("vpd", "hpd", "nav"), "EPSG:4326"), {"vpd": ("trace_id",), "nav": ("func_class", "dir_travel")})


@query("cell_speeds_nearby")
def cell_speeds_nearby(p: DataFrame) -> DataFrame:
    """Nodes of the road graph and the nearest other within 45."""
    n = network.nodes(network.labelled(p)).select(F.col("node").alias("id"), "x", "y")
    return spatial.within(n, n, 45.0).where("a <> b").groupBy("a").agg(F.min("dist").alias("dist"), F.count("*").alias("near")).select("a", r6("dist"), "near")
