"""Connected components by alternating large-star and small-star steps, each an aggregation and a join.

Labels never leave the cluster; each round is written to the shared folder, which cuts the lineage. The number
of rounds is logarithmic in the longest path. A vertex with many neighbours is reduced by partial aggregation
and joined back by a join whose large side adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) without loops. Large: every larger neighbour goes to the least one;
    small: the vertex and every smaller neighbour do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", scratch: Scratch | None = None) -> DataFrame:
    """(vertex, component) for every vertex of an edge table of longs; component is its smallest vertex.

    Loops and repeated edges don't matter; rows with a null end are ignored; no edges give no rows. The rounds but the last are
    deleted; the last one stays until scratch is cleared.
    """
    keep = scratch or Scratch(edges.sparkSession)
    own = Scratch(edges.sparkSession)
    now = own.write(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = state(now)
    while before[0]:
        following = Scratch(edges.sparkSession)
        now = following.write(_star(_star(now, True), False))
        own.clear()
        own = following
        after = state(now)
        if after == before:
            break
        before = after
    keep.paths += own.paths
    found = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())
