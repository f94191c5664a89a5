"""Connected components by alternating stars, in tables that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.llm.shared import cut


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node on a link ``a``, ``b``.

    A large star hangs each node's larger neighbours on its smallest one, a small star its smaller
    neighbours; the edges shrink to one star per component in a number of rounds that grows with
    the logarithm of the size. Minima are combined before the shuffle and cut before the join, so
    that the rows of a hub can be split among tasks.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(
            both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        roots = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        edges = cut(
            large.join(roots, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(roots.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
