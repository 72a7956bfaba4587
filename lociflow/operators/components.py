"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.shared import cut


def _star(edges: DataFrame) -> DataFrame:
    """Every neighbour of ``u`` is tied to the smallest of ``u`` and its neighbours.

    The minimum is a map-side combined aggregate that is joined back, so a hub with very many
    neighbours is no single window group: Spark splits the join's large partitions.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return edges.join(low, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    tied = _star(down)
    return (
        tied.select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionByName(tied.select("u", F.col("low").alias("v")))
        .where("u <> v")
        .distinct()
    )


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Nodes are of any orderable type. Edges with a null end are ignored, self-loops and repeats do no
    harm, and a node whose only edge is a self-loop is its own component. Each round writes its edges
    to the shared folder, in files by their count; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = None
    now = cut(pairs.distinct(), "edges")
    loops = now.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = now.where("u <> v")
    before = None
    while (state := _state(now)) != before:
        before = state
        if state[0] == 0:
            break
        now = cut(_small(_large(now)), "edges", state[0])
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
