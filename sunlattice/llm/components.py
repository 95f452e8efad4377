"""Connected components by alternating large-star and small-star rounds, all of them joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut, discard


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected `edges` (u, v); label is the smallest node reachable.

    Nodes are of any orderable type. Loops and repeated edges are ignored, rows with a null end take no part, and an
    empty table gives an empty result. Each round is written to the shared folder; rounds go on until nothing changes
    (logarithmically many in practice), so no depth is assumed.
    """
    now = cut(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written before they are joined, so that Spark can split the edges of a node with very many
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, now = now, cut(small)
        discard(before)
        discard(least)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
