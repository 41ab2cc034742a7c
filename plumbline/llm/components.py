"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import sized, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step: each node's (larger, or smaller and own) neighbours are linked to the least of its neighbourhood.

    The least neighbours are a table of their own, so that a node with very many
    links can be split in the join.
    """
    if large:
        ends = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = ends.filter("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = written(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = links.join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node that can be reached.

    links: u, v (comparable, not null); direction, repeats and loops do not
    matter. Alternating large-star and small-star steps, of which a number
    logarithmic in the size of a component is needed; neighbourhoods are reduced
    to their minimum by pre-aggregation and never gathered, and each step is a
    written table. The roots themselves are included. No link: no row.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, seen = written(links, "links"), None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        links = written(_stars(_stars(links, True), False), "links")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
