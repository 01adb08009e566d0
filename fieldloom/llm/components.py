"""Connected components of a table of links, by alternating large-star and small-star steps over locally contracted links.

Every task first contracts the links it holds to stars, by union and find over a bounded number of nodes at a time: what is connected stays
connected, and no link has to move for it. Then rounds of both steps join the stars of different tasks, until all are whole. Each round is a few
aggregations and joins; it is written to the shared folder, so lineage stays short and a lost executor costs one round. Minima
are aggregated before they are joined, so a node with very many links needs no group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import materialize, release

#: Nodes that a task holds at once while it contracts links.
HELD = 1 << 19


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) that connect what links connect: within a task, each node points once at the smallest it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        def stars() -> pa.RecordBatch:
            nodes = [x for x, y in root.items() if x != y]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(u), find(v)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > HELD:
                yield stars()
                root.clear()
        yield stars()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def whole(links: DataFrame) -> bool:
    """Whether links (u, v) are stars: every u has one v, and no v is a u."""
    ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
    nodes = ends.groupBy("u").agg(F.min("v").alias("_least"), F.max("v").alias("_most"), F.max(F.col("v").isNull()).alias("_parent"))
    return nodes.where("_least < _most OR (_parent AND _least IS NOT NULL)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long): root is the smallest node reachable. Loops and repeats don't matter; nulls are left out."""
    edges = materialize(contracted(links.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    while not whole(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined: a join of two plain shuffles is one whose skewed parts Spark can split
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        large = materialize(contracted(large), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(contracted(small), "links")
        for old in (least, large, low, edges):
            release(old)
        edges = after
    # at the end every node but the roots points at its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
