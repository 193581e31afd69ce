"""Connected components of an edge table by alternating stars; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component: the smallest node reachable.

    Each round links a node's larger neighbours, then its smaller ones, to its smallest neighbour. The least neighbour
    is an aggregate with a map-side combine, joined back; the join deals by node, and where a hub's edges make a partition
    too large Spark splits it, since only the side of one row for each node is repeated. Each round is written to the
    shared folder. Rounds grow with the logarithm of the longest path; more than rounds of them is an error. Edges of a node with itself are left out; an empty table has no components."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, "edges")
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
