"""Command line: make a network from traces, score one against a map, clean one of double lines, check the inputs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roadloom.operators import carriageways, checks, scores
from roadloom.plans import algorithms
from roadloom.sources import bundles, maps, sinks, traces


def _floats(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="roadloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    made = sub.add_parser("generate", help="network from vehicle paths and probes")
    made.add_argument("--vpd", required=True)
    made.add_argument("--hpd", nargs="*", default=[])
    made.add_argument("--algorithm", default="windows", choices=algorithms.available())
    made.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    made.add_argument("--zone", type=int, default=34)
    made.add_argument("--out", required=True)
    score = sub.add_parser("evaluate", help="score of a network against a map")
    score.add_argument("--net", required=True)
    score.add_argument("--truth", required=True)
    score.add_argument("--buffer", type=float, default=15.0)
    score.add_argument("--step", type=float, default=10.0)
    score.add_argument("--radii", type=_floats, default=[8.0, 15.0])
    score.add_argument("--out", required=True)
    clean = sub.add_parser("clean", help="network without lines drawn twice")
    clean.add_argument("--net", required=True)
    clean.add_argument("--out", required=True)
    test = sub.add_parser("validate", help="checks of the inputs; fails if one fails")
    test.add_argument("--vpd", required=True)
    test.add_argument("--hpd", nargs="+", required=True)
    test.add_argument("--nav", required=True)
    test.add_argument("--box", required=True)
    return top


def _number(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def _probes(spark: SparkSession, paths: list[str]):
    raw = [traces.read_tabular(spark, p, traces.HPD_SCHEMA) for p in paths]
    out = raw[0]
    for r in raw[1:]:
        out = out.unionByName(r)
    return traces.probe_traces(out).withColumn("trace_id", F.concat_ws("_", "traceid", "day")).withColumn("source", F.lit("HPD"))


def _named(df):
    return df.withColumn("id", F.xxhash64(F.monotonically_increasing_id())) if "id" not in df.columns else df.withColumn("id", F.xxhash64("id"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("roadloom").getOrCreate()
    if args.command == "generate":
        d = traces.vehicle_paths(traces.read_tabular(spark, args.vpd, traces.VPD_SCHEMA))
        d = traces.fuse(d, _probes(spark, args.hpd)) if args.hpd else d
        d = maps.projected(d, args.zone).withColumn("trace_id", F.xxhash64("trace_id"))
        points = traces.points_of(d)
        bundles.write_result(algorithms.generate(args.algorithm, points, d.select("trace_id", "line"), **{k: _number(v) for k, v in (x.split("=", 1) for x in args.set)}), args.out)
    elif args.command == "evaluate":
        net, truth = (_named(maps.read_lines(spark, p)) for p in (args.net, args.truth))
        sinks.write_metrics(scores.evaluate(net, truth, args.buffer, args.step, args.radii), args.out)
    elif args.command == "clean":
        sinks.write_lines(carriageways.cleaned(_named(maps.read_lines(spark, args.net))), args.out)
    else:
        raw = traces.read_tabular(spark, args.vpd, traces.VPD_SCHEMA)
        box = maps.read_box(spark, args.box)
        nav = maps.road_map(traces.read_tabular(spark, args.nav))
        vpd = traces.vehicle_paths(raw).withColumn("fused", F.lit("yes"))
        found = checks.run_all(vpd, _probes(spark, args.hpd), nav, box, dict.fromkeys(("vpd", "hpd", "nav"), "EPSG:4326"), {"vpd": ("trace_id", "line"), "hpd": ("line",), "nav": ("func_class",)}).cache()
        print(checks.report(found))
        return int(found.where("status = 'FAIL'").count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
