"""Connected components of a table of links, by stars: no list of links or members ever comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, Scratch, counted, frequent, skew_join

MOST_ROUNDS = 60


def _stars(links: DataFrame, scratch: Scratch, few: bool) -> bool:
    """Has every left node one right node, and is none of those a left node?"""
    one = lambda: links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    right = links.select(F.col("v").alias("u"))
    if few:  # what needs no shuffle is asked first
        return links.join(F.broadcast(right), "u", "left_semi").limit(1).count() == 0 and one()
    return one() and skew_join(links, right.distinct(), "u", "v", _hot(links, scratch, few)).limit(1).count() == 0


def _hot(rows: DataFrame, scratch: Scratch, few: bool) -> DataFrame | None:
    return None if few else frequent(counted(rows, "u"), scratch)


def _large(links: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return skew_join(both, least, "u", "v", _hot(both, scratch, few), few=few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame, scratch: Scratch, few: bool) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = skew_join(links, least, "u", "v", _hot(links, scratch, few), few=few).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label): for each node of links (u, v: of a type that has an order, in either order), the smallest node that it is connected with.

    Rounds of large and small stars, each of which is written to the shared folder, until all
    links are stars around the smallest node. Repeated links and links of a node with itself do no harm;
    a node with no other link doesn't appear. Many links of one node are added up before they are shuffled.
    Where the nodes are FEW_ROWS at most, what is found for each is broadcast, so that links are shuffled for sums only.
    The rounds' tables go to scratch, if given; whoever gives it deletes them.
    """
    scratch = scratch or Scratch(links.sparkSession)
    now = scratch.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        few = now.count() <= FEW_ROWS // 2  # a link has two nodes
        if _stars(now, scratch, few):
            break
        # repeated links do no harm meanwhile; there are no more of them than before
        large = _large(now, scratch, few)
        large = scratch.written(large if few else large.distinct(), "links")
        now = scratch.written(_small(large, scratch, few).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
