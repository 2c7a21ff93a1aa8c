"""Writers of whole results: nodes, edges and centerlines together, preprocessed traces, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions import geometry as g
from roadloom.operators.scores import side_by_side
from roadloom.plans.algorithms import Result
from roadloom.sources.sinks import flat


def as_text(df: DataFrame) -> DataFrame:
    """Lines as WKT, other arrays, maps and structs as JSON; arrays of text sorted."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "line":
            out.append(g.to_wkt("line").alias("geometry_wkt"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(F.to_json(F.array_sort(c)).alias(f.name))
        else:
            out.append(F.to_json(c).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else c)
    return df.select(*out)


def write_result(result: Result, folder: str, csv: bool = True) -> None:
    """Nodes, edges and centerlines as Parquet, centerlines as CSV as well, and a summary."""
    made = {"nodes": result.nodes, "edges": result.edges, "centerlines": result.centerlines}
    for name, df in made.items():
        as_text(df).write.mode("overwrite").parquet(f"{folder}/{name}")
    if csv:
        as_text(result.centerlines).write.mode("overwrite").csv(f"{folder}/centerlines_csv", header=True)
    spark = result.nodes.sparkSession
    counts = [spark.read.parquet(f"{folder}/{k}").agg(F.count("*").alias(k)) for k in made]
    side_by_side(*counts).withColumns({f"setting_{k}": F.lit(v) for k, v in result.settings.items()}).write.mode("overwrite").json(f"{folder}/summary")


def write_traces(traces: DataFrame, folder: str, settings: dict) -> None:
    """Preprocessed traces with arrays as JSON, and how many there are of every source."""
    flat(as_text(traces)).write.mode("overwrite").parquet(f"{folder}/traces")
    by = traces.groupBy("source").agg(F.count("*").alias("n")) if "source" in traces.columns else traces.agg(F.count("*").alias("n")).withColumn("source", F.lit(None).cast("string"))
    by.withColumns({f"setting_{k}": F.lit(v) for k, v in settings.items()}).write.mode("overwrite").json(f"{folder}/summary")


def write_both_systems(net: DataFrame, degrees: DataFrame, folder: str) -> None:
    """A network in metres and in degrees, side by side."""
    as_text(net).write.mode("overwrite").parquet(f"{folder}/metres")
    as_text(degrees).write.mode("overwrite").parquet(f"{folder}/degrees")
