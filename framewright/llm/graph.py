"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is one aggregation and one join on a node, both of which combine before the shuffle; no component is gathered
anywhere.  Each round is written to the shared checkpoint folder, and the round before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_tables, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on (u, v) rows with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.  Null ends and self-links say nothing.

    An empty link table gives an empty result.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    spark = links.sparkSession
    paths: list[str] = []
    edges = stash(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), paths)
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        old = [paths.pop()]
        edges = stash(_star(_star(edges, True), False), paths)
        drop_tables(spark, old)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
