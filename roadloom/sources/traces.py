"""Reading traces, probe points and road maps, and the portable traces derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions import geometry as g

VPD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("driveid", "fused", "path", "altitudes", "constructionpercent", "crosswalktypes", "trafficsignalcount", "day", "startoffset", "endoffset", "pathqualityscore", "sensorqualityscore")]
)
HPD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("traceid", "day", "time", "latitude", "longitude", "speed", "heading")])


def read_tabular(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV or Parquet by suffix; a missing column is an error."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="PERMISSIVE") if schema is not None else spark.read.csv(path, header=True)
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df.select(*columns) if columns else df


def vehicle_paths(raw: DataFrame, fused_only: bool = True, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Canonical traces of raw path lines: parts of multi-part lines become traces of their own.

    Bad numbers become null or 0 as the column's use asks; lines that do not parse are dropped.
    """
    d = raw.where(g.flag("fused")) if fused_only else raw
    d = d.select("*", F.posexplode(g.parse_wkt("path")).alias("part", "line"), F.size(g.parse_wkt("path")).alias("parts"))
    if box:
        d = d.where(g.any_vertex_in("line", box))
    number = lambda c: F.col(c).try_cast("double")
    return d.select(
        F.when(F.col("parts") > 1, F.concat("driveid", F.lit("_p"), "part")).otherwise(F.col("driveid")).alias("trace_id"),
        F.lit("VPD").alias("source"),
        "line",
        number("day").cast("int").alias("day"),
        F.floor(F.pmod(number("startoffset"), F.lit(86400.0)) / 3600).cast("int").alias("hour"),
        F.coalesce(number("constructionpercent"), F.lit(0.0)).alias("construction_percent"),
        g.parse_numbers("altitudes").alias("altitudes"),
        F.coalesce(number("trafficsignalcount"), F.lit(0.0)).alias("traffic_signal_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number("pathqualityscore"))).alias("path_quality_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number("sensorqualityscore"))).alias("sensor_quality_score"),
    )


def probe_traces(raw: DataFrame, keys: tuple[str, ...] = ("traceid", "day"), min_speed: float | None = None) -> DataFrame:
    """Traces of probe points: ordered lines per key with medians; rows without a time or place are dropped."""
    when = F.try_to_timestamp("time", F.lit("HH:mm:ss"))
    d = raw.select(
        "traceid",
        F.col("day").try_cast("int").alias("day"),
        (F.hour(when) * 3600 + F.minute(when) * 60 + F.second(when)).alias("second"),
        F.col("longitude").try_cast("double").alias("x"),
        F.col("latitude").try_cast("double").alias("y"),
        F.col("speed").try_cast("double").alias("speed"),
        F.col("heading").try_cast("double").alias("heading"),
    ).where("second IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("day", "second", "x", "y")))
    d = d.groupBy(*keys).agg(
        F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"),
        F.count("*").alias("point_count"),
        F.avg("speed").alias("avg_speed"),
        F.median("speed").alias("median_speed"),
        F.median("heading").alias("median_heading"),
        F.min("second").alias("time_start"),
        F.max("second").alias("time_end"),
    )
    d = d.where("point_count >= 2").where(g.line_length("line") > 0)
    return d.where(F.col("avg_speed") >= min_speed) if min_speed is not None else d


def fuse(*traces: DataFrame) -> DataFrame:
    """All traces together by column name, absent columns null, without empty geometries."""
    out = traces[0]
    for t in traces[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.where(F.col("line").isNotNull() & (F.size("line") >= 2))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the grid city that ``events`` spell: ten roads east-west and ten north-south, 60 apart."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    d = e.select("event_id", "ts", "value", F.col("user_id").alias("trace_id"), pos.alias("pos"))
    road = F.col("trace_id") % 20
    s = F.when(F.col("trace_id") % 3 == 0, 12.0 * (100 - F.col("pos"))).otherwise(12.0 * F.col("pos"))
    jx = 0.1 * ((F.col("event_id") * 7919) % 61 - 30)
    jy = 0.1 * ((F.col("event_id") * 104729) % 61 - 30)
    flat = road < 10
    return d.select(
        "trace_id",
        F.col("pos").cast("long").alias("pos"),
        road.cast("long").alias("road"),
        F.when(flat, s + jx).otherwise(60.0 * (road - 10) + jx).alias("x"),
        F.when(flat, 60.0 * road + jy).otherwise(s + jy).alias("y"),
        F.col("value").alias("speed"),
        F.when(F.col("event_id") % 2 == 0, "VPD").otherwise("HPD").alias("source"),
        F.hour("ts").cast("long").alias("hour"),
        F.when(flat, 100.0).otherwise(110.0).alias("altitude"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"),
        "event_id",
    )


def lines(pts: DataFrame) -> DataFrame:
    """One row per trace with its ordered line."""
    p = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    return pts.groupBy("trace_id").agg(F.transform(p, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))


#: The same points for DuckDB.
POINTS_SQL = """pts AS (
  SELECT trace_id, pos, road,
    CASE WHEN road < 10 THEN s + jx ELSE CAST(60 AS DOUBLE) * (road - 10) + jx END AS x,
    CASE WHEN road < 10 THEN CAST(60 AS DOUBLE) * road + jy ELSE s + jy END AS y,
    value AS speed, CASE WHEN event_id % 2 = 0 THEN 'VPD' ELSE 'HPD' END AS source,
    CAST(hour(ts) AS BIGINT) AS hour, CAST(CASE WHEN road < 10 THEN 100 ELSE 110 END AS DOUBLE) AS altitude,
    CAST(floor(epoch(ts)) AS BIGINT) AS second, event_id
  FROM (SELECT *, user_id AS trace_id, user_id % 20 AS road,
          CASE WHEN user_id % 3 = 0 THEN CAST(12 AS DOUBLE) * (100 - pos) ELSE CAST(12 AS DOUBLE) * pos END AS s,
          CAST(0.1 AS DOUBLE) * ((event_id * 7919) % 61 - 30) AS jx, CAST(0.1 AS DOUBLE) * ((event_id * 104729) % 61 - 30) AS jy
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)))"""


def points_of(lines_: DataFrame) -> DataFrame:
    """Points of traces (``trace_id, line`` and, where known, ``source``, ``hour``) in order, with what the graph needs of each."""
    known = lambda c, kind: F.col(c).cast(kind) if c in lines_.columns else F.lit(None).cast(kind)
    d = lines_.select("trace_id", F.coalesce(known("source", "string"), F.lit("VPD")).alias("source"), known("hour", "long").alias("hour"), known("median_speed", "double").alias("speed"), F.posexplode("line").alias("pos", "p"))
    return d.select("trace_id", F.col("pos").cast("long"), "p.x", "p.y", "source", "hour", F.coalesce("speed", F.lit(1.0)).alias("speed"), F.lit(None).cast("double").alias("altitude"))


def grid_roads(spark: SparkSession) -> DataFrame:
    """The true roads of the grid city: ``id, func_class, line``."""
    d = spark.range(20).withColumn("func_class", (F.col("id") % 5 + 1).cast("int"))
    at = lambda s: F.when(F.col("id") < 10, F.struct(F.lit(float(s)).alias("x"), (60.0 * F.col("id")).alias("y"))).otherwise(F.struct((60.0 * (F.col("id") - 10)).alias("x"), F.lit(float(s)).alias("y")))
    return d.select("id", "func_class", F.array(*(at(s) for s in range(0, 1201, 60))).alias("line"))
