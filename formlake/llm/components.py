"""Connected components of links between integer nodes, by alternating large and small stars in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.durable import checkpointed

#: Links of a partition.
ROWS = 200_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node that is larger (large) or smaller than it to the least of its neighbourhood. No pairs of neighbours arise."""
    near = links.select("a", "b")
    if large:
        near = near.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    own = least.select("a", F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node reachable over links (columns a, b), for every node of a link between two nodes."""
    now = checkpointed(links.select("a", "b").filter("a <> b").distinct(), ROWS)
    mark = None
    while True:
        now = checkpointed(_star(_star(now, True), False), ROWS)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    ends = now.groupBy("a").agg(F.min("b").alias("b"))
    nodes = ends.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = ends.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
