"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import stored


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Point the larger (or, for ``small``, the smaller) neighbours of each node at its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    low = F.least("a", "low")
    joined = both.join(least, "a")
    if small:
        moved = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ends = least.select("a", F.col("low").alias("b"))
        return moved.unionByName(ends).distinct()
    return joined.filter("b > a").select(F.col("b").alias("a"), low.alias("b")).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node reachable.

    Every round is a written table, so lost executors cost one round at most; the driver sees two numbers
    a round. Nodes with many links are aggregated before the shuffle, and their join splits.
    """
    clean = links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b")
    current = stored(clean.select("a", "b").distinct(), label)
    before, after = None, _state(current)
    while after != before and after[0]:
        current = stored(_star(_star(current, small=False), small=True), label)
        before, after = after, _state(current)
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
