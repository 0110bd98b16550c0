"""Connected components of a link table by alternating large-star and small-star rounds (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, measured

#: What tells whether a round has changed the edges.
PRINT = {"n": "count(1)", "s": "sum(cast(hash(u, v) AS long))"}


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node that has a link; self-links and repeats are allowed.

    Each round points nodes at the least neighbour seen so far; long paths shorten by powers. Every round, and the result,
    is written to the shared folder; earlier rounds are deleted. A node with many links is only ever reduced by ``min``, which combines before the shuffle.
    Null nodes have no links. An empty table gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = materialize(edges, "edges", PRINT)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        following = materialize(small, "edges", PRINT)
        same = measured(following) == measured(edges)
        discard(edges)
        edges = following
        if same:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    found = materialize(found, "components")
    discard(edges)
    return found
