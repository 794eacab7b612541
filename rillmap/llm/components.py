"""Connected components of a table of links, without collecting any of them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b: long); a component is named by its smallest node.

    Every round takes the smallest name among a node's neighbours and then the name of that name, so the rounds grow with the logarithm of the
    longest path in practice. Each round is cut by a checkpoint.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct())
    names = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("component")))
    while True:
        seen = both.join(names.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("n"))
        near = names.join(seen, "node").select("node", F.least("component", "n").alias("component"), F.col("component").alias("old"))
        far = names.select(F.col("node").alias("component"), F.col("component").alias("n"))
        new = cut(near.join(far, "component").select("node", F.least("component", "n").alias("component"), "old"))
        moved = new.where(F.col("component") < F.col("old")).limit(1).count()
        names = new.drop("old")
        if not moved:
            return names
