"""Session defaults and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("roadloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in a local session where none is set."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
    if not named:
        named = tempfile.mkdtemp(prefix="roadloom-ckpt-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed columnar table in the same shared folder; for larger intermediates."""
    place = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` materialised and, where it has few rows, to be broadcast, so that what it is joined to stays in place."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
