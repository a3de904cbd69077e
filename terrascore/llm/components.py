"""Connected components of a graph of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.base import stage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b`` longs): ``root`` is the smallest node of its component.

    In each round a node takes the smallest root among its neighbours' and its own,
    then the root of that root. Both are aggregates and joins that split a hot node;
    each round is written to the shared folder, so that a lost executor costs no more
    than a round. Ends when a round changes nothing; no links give no rows.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("r").alias("r"))
        lower = roots.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = stage(lower.join(up, "root").select("node", "old", F.least("root", "up").alias("root")), "roots")
        if not moved.where(F.col("old") != F.col("root")).limit(1).count():
            return moved.select("node", "root")
        roots = moved.select("node", "root")
