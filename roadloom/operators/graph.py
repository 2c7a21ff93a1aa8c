"""Distributed connected components over an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", single_task_edges: int = 200_000, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id that occurs in an edge between two different ids.

    The component is its smallest member. Alternates large-star and small-star rounds, so the number of
    rounds grows with the logarithm of the longest path. Every round shuffles the surviving edges only and
    pre-aggregates the minimum neighbour map-side, so a hub costs one row per map task. Up to
    ``single_task_edges`` edges (counted, a few MB) are solved by one task with union-find instead, which
    spares the rounds. Ids are longs, or strings beyond the single-task path too. Null ends, self loops and repeated edges are ignored; an empty table gives an empty result.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = cut(e)
    if single_task_edges and e.limit(single_task_edges + 1).count() <= single_task_edges:
        kind = e.schema["a"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_union_find, f"id {kind}, component {kind}")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a != b")
            .distinct()
        )
        e = cut(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _union_find(batches):
    """Components of all edges of one task."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    if kind is not None:
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([find(x) for x in ids], kind)], names=["id", "component"])
