"""Connected components as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelake.llm.common import discard, stored


def _checksum(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge table; the component is its smallest node.

    Alternating star steps: first each node's larger neighbours are linked to its smallest one,
    then its smaller neighbours; the rounds grow with the logarithm of the longest path. Smallest
    neighbours are combined on the map side, and the join that hands them back is a plain equi-join
    whose hot keys adaptive execution splits. Each round is written to the shared folder, so a lost
    executor costs one round at most. Loops and edges with a null end add nothing.
    """
    x, y = F.col(a), F.col(b)
    links = stored(
        edges.filter(x != y).select(F.greatest(x, y).alias("big"), F.least(x, y).alias("small")).distinct(), "links"
    )
    before = _checksum(links)
    while before[0]:
        both = links.select(F.col("big").alias("u"), F.col("small").alias("v")).union(links.select("small", "big"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("big"), F.col("m").alias("small"))
        large = stored(large.distinct(), "links")
        low = large.groupBy("big").agg(F.min("small").alias("m"))
        rest = large.join(low, "big").filter(F.col("small") != F.col("m")).select(F.col("small").alias("big"), F.col("m").alias("small"))
        following = stored(low.select("big", F.col("m").alias("small")).union(rest).distinct(), "links")
        discard(large)
        discard(links)
        links, after = following, _checksum(following)
        if after == before:
            break
        before = after
    return links.select(F.col("big").alias("node"), F.col("small").alias("component")).union(
        links.select("small", "small").distinct()
    )
