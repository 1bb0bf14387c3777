"""Connected components of a graph by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task contracts at a time; bounds its memory.
FOREST_EDGES = 1_000_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for nodes with an edge.

    Tasks first replace their own edges by stars, which needs no shuffle.  Then
    large-star and small-star steps alternate until nothing changes; the number
    of rounds grows with the logarithm of the longest chain.  Each round is
    written to the shared folder: lineage stays short and lost executors cost
    one step.  Loops are ignored; an empty graph has no nodes.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = pairs.filter("u <> v")
    pairs = stored(pairs.mapInArrow(_stars, "u long, v long"), "components")
    before = None
    while True:
        pairs = stored(_small_star(_large_star(pairs)), "components")
        # Three numbers, whatever the size of the graph.
        after = pairs.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))
        ).first()
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.selectExpr("v as u", "u as v"))
    least = stored(
        both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least"
    )
    return both.filter("v > u").join(least, "u").selectExpr("v as u", "m as v").filter(
        "u <> v"
    ).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    down = stored(
        pairs.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "components-down"
    )
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    moved = down.join(least, "u").selectExpr("v as u", "m as v")
    return moved.unionByName(least.selectExpr("u", "m as v")).filter("u <> v").distinct()


def _stars(batches):
    """Edges of a task, contracted block by block to stars around the smallest node."""

    def flush(u, v):
        root = {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for x, y in zip(u, v, strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())],
            names=["u", "v"],
        )

    u, v = [], []
    for batch in batches:
        u += batch.column("u").to_pylist()
        v += batch.column("v").to_pylist()
        if len(u) >= FOREST_EDGES:
            yield flush(u, v)
            u, v = [], []
    if u:
        yield flush(u, v)
