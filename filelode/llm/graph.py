"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a partial aggregate (the smallest neighbour of a node) joined back to the links, so no node's neighbours
are ever gathered in one place and a hub is a skewed join side that adaptive execution splits. Links are checkpointed
after each round; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm.common import checkpoint


def _hooked(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node that isn't the smallest of its component.

    Nodes are longs; ``component`` is the smallest node reachable. Loops, repeated links and either direction are
    accepted; links with a null end are ignored. No links: no rows.
    """
    now = checkpoint(
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    seen = now.agg(mark.alias("m")).first()["m"]
    while seen[0]:
        now = checkpoint(_hooked(now))
        last, seen = seen, now.agg(mark.alias("m")).first()["m"]
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
