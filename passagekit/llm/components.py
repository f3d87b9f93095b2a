"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagekit.scale import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones, onto
    the smallest node around, until every node hangs on its root. Minima are
    aggregated before they are shuffled, and a node with very many links is a join
    key that Spark may split. Every round is a stored table.
    """
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, mark = _stored(pairs)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "stars")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = mark
        edges, mark = _stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))))
        if mark == before:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _stored(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct pairs as a stored table, and what tells two tables apart."""
    edges = stage(pairs.distinct(), "links")
    # Sums of 32-bit parts cannot overflow.
    parts = [F.sum(F.shiftright(F.xxhash64("u", "v"), n).bitwiseAND(0xFFFFFFFF)) for n in (0, 32)]
    return edges, tuple(edges.agg(F.count("*"), *parts).first())
