"""Connected components of a graph of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least node of its neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``links(a, b)``; root: the least id of its component.

    Alternates the two star operations, whose rounds grow with the logarithm of
    the longest path, until a round changes nothing.  Links with a null end are
    left out; repeated links and loops change nothing; no links give no rows.
    """
    links = materialize(links.where("a is not null and b is not null and a <> b").select("a", "b"), "links")
    before = None
    while True:
        links = materialize(_small_star(_large_star(links)), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
