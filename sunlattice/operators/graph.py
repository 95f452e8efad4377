"""Connected components of edge tables, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.sources.tables import cut, discard


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected `edges` (u, v); label is the smallest node reachable.

    Nodes are of any orderable type (structs too). Loops, repeated edges and edges with a null end change nothing. Each round
    hangs every node's larger neighbours on its smallest one and then every node on the smallest of what it hangs on, and
    is written to the shared folder; rounds go on, logarithmically many in practice, until the edges stay the same.
    """

    mark = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("u", "v")), "y": F.bit_xor(F.xxhash64("v", "u"))}
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **mark)
    while now.noted["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = hung.groupBy("u").agg(F.min("v").alias("m"))
        rest = hung.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(rest.unionByName(down.withColumnRenamed("m", "v")).distinct(), **mark)
        discard(before)
        if now.noted == before.noted:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
