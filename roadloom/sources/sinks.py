"""Writers of lines, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions import geometry as g


def flat(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns of joined names; arrays and maps as JSON."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                col = F.col(".".join(f"`{p}`" for p in here))
                yield (F.to_json(col) if isinstance(f.dataType, T.ArrayType | T.MapType) else col).alias(sep.join(here))

    return df.select(*leaves(df.schema))


def write_lines(df: DataFrame, path: str, line: str = "line", csv: bool = False) -> None:
    """Parquet, or CSV with a header, with the line as WKT."""
    out = flat(df.withColumn("geometry_wkt", g.to_wkt(line)).drop(line))
    out.write.mode("overwrite").csv(path, header=True) if csv else out.write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """The metrics as nested JSON, and flattened as Parquet beside it."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat(df).write.mode("overwrite").parquet(f"{path}/parquet")
