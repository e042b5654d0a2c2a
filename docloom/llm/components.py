"""Connected components by Hash-to-Min (Rastogi et al., 2013), on relations instead of lists.

Every node starts with the cluster of itself and its neighbours. In each round a node sends
its cluster to the smallest member and the smallest member to the whole cluster. In the end
the smallest node of a component holds the component and every other node holds only it.

Clusters are rows ``(node, member)``, never arrays: a component may hold a third of all nodes
and is still spread over the partitions. The minimum is a partial aggregate, repeated rows are
removed by ``distinct`` before and after each exchange, and the join of a large cluster with its
minimum is one Spark can split (AQE skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the undirected ``edges``; component is the smallest node.

    Nulls at either end make no edge; loops keep their node as a component of its own; repeated
    edges count once. An empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = F.explode(F.array(*(F.struct(F.col(p).alias("node"), F.col(q).alias("member")) for p, q in (("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")))))
    clusters = materialize(e.select(both.alias("r")).select("r.*").distinct(), "clusters")
    before = None
    for _ in range(max_rounds):
        least = clusters.groupBy("node").agg(F.min("member").alias("least"))
        sent = F.explode(F.array(F.struct(F.col("least").alias("node"), F.col("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member"))))
        clusters = materialize(clusters.join(least, "node").select(sent.alias("r")).select("r.*").distinct(), "clusters")
        now = clusters.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "member")), F.sum(F.xxhash64("node", "member").cast("decimal(20,0)"))).first()
        if now == before:
            return clusters.groupBy("node").agg(F.min("member").alias("component"))
        before = now
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")
