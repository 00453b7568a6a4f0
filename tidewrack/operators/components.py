"""Connected components by alternating stars: every step is a grouped minimum and a join, lineage is cut every round. Edges
counted to be few are joined in one task instead of many rounds of shuffles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.session import cut

MOST_ROUNDS = 60
#: Distinct edges up to which one task holds them all: some tens of MB.
IN_ONE = 200_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    around = _both(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Here every edge has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(edges: DataFrame) -> DataFrame:
    """node, component of a bounded number of edges, in one task."""

    def apply(batches):
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(apply, f"node {kind}, component {kind}")


def components(edges: DataFrame, most_rounds: int = MOST_ROUNDS, in_one: int = IN_ONE) -> DataFrame:
    """node, component: the least node reachable, for every node on an edge. ``edges`` has a and b of one orderable type.

    Loops and repeated edges are fine; no edges give no rows. Rounds grow with the logarithm of the longest path.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.limit(in_one + 1).count() <= in_one:
        return _joined(now)
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
