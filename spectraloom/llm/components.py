"""Connected components of a link table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of `links` with the smallest node it reaches.

    A step groups links by node only to take a minimum, which combines before the shuffle, so a node with
    very many links is no hot group. Each round is written to the checkpoint folder; rounds end when the
    links no longer change, after a number of rounds that grows with the logarithm of the longest chain.
    Links with a null end are left out, repeated ones and loops make no difference, no link gives no row.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    nodes = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    print_of = None  # number of links and a hash over them all
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself are linked to the smallest of them
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = cut(small)
        print_of, before = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first(), print_of
        if print_of == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))
