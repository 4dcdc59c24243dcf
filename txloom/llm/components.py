"""Connected components by joins, for links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links; two sums of 64-bit hashes tell sets of a size apart."""
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(7, u, v))")).first())


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp (the least node it reaches), for each row of nodes (one column); links: columns a, b.

    Alternates the large-star and small-star steps, whose number grows as the logarithm of the longest path,
    and which never list a component's pairs: every step has at most as many links as there were.
    Nodes without links are their own component. Links to themselves and repeated links do no harm; a link with a null end
    is none. A null node is its own component's null. Tables may be empty.
    """
    name = nodes.columns[0]
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL").filter("u <> v").distinct())
    seen = None
    while (mark := _mark(now)) != seen:
        seen = mark
        both = now.union(now.select("v", "u"))
        # written before the join, so that both its sides are exchanges and a component's root can be split
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        now = cut(small)
    return nodes.join(now.select(F.col("u").alias(name), F.col("v").alias("_root")), name, "left").select(F.col(name).alias("node"), F.coalesce("_root", name).alias("comp"))
