"""Connected components of an edge table by alternating large and small stars, all in Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import drop_scratch, materialise

#: A graph of at most so many edges is solved in one task.
ONE_TASK = 15_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
    return r["n"], r["h"]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = sorted(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is its smallest node. No row for nodes without edges.

    Null ends and loops are ignored, repeated edges count once. Each step is written to the shared folder; the number of steps
    grows with the logarithm of the longest path. What is left of ONE_TASK edges or fewer is solved in one task of that bounded size."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        if before[0] <= ONE_TASK:
            return _in_one_task(edges)
        # what is joined are tables, so that the rows of a node with very many neighbours can be split among tasks
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(_least(both).withColumn("m", F.least("m", "a")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = materialise(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
        lower = materialise(_least(down), "lower")
        small = down.join(lower, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, edges = edges, materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        for table in (old, least, down, lower):
            drop_scratch(edges.sparkSession, table.scratch)
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
