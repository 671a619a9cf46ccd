"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.llm.staging import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high")), F.bit_xor(F.xxhash64("high", "low"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named after its smallest node.

    Alternating large and small stars: every round hangs the neighbours of a node below the smallest of them. Neighbours
    are reduced by a partial minimum and joined back, so a node with very many of them is never gathered. Rounds go on
    until nothing moves; each is written out. Loops and repeated edges change nothing, null ends are ignored.
    """
    now = staged(edges.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    state = _state(now)
    while True:
        # Large star: every larger neighbour of a node moves to the smallest of the node and its neighbours.
        both = now.union(now.select("high", "low")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = (
            both.filter("other > node").join(least, "node")
            .select(F.col("least").alias("low"), F.col("other").alias("high")).filter("low < high").distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(F.col("least").alias("low"), F.col("low").alias("mid"), "high")
        after = staged(
            small.select("low", F.explode(F.array("mid", "high")).alias("high")).filter("low < high").distinct(), "edges"
        )
        now, last = after, state
        state = _state(now)
        if state == last:
            break
    nodes = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return nodes.union(roots)
