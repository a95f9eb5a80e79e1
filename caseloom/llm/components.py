"""Connected components of a link table, by alternating large and small stars.

Every round is a few grouped minima and joins over the links; no node's
neighbours are ever gathered in one place. Rounds are written to the shared
folder, which cuts the lineage; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.plans.store import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a").filter("b > a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links(a, b)``; the root is the component's smallest node.

    A link from a node to itself adds nothing. No links give no rows.
    """
    links = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = stored(_small_star(_large_star(links)), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
