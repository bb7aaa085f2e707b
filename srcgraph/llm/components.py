"""Connected components by contraction, as joins and sums over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop, stage

#: For each round, what node numbers are XORed with before they are compared, so that no order of nodes stays bad.
SALTS = (0x0000000000000000, 0x5555555555555555, 0x3333333333333333, 0x6996966996696996, 0x0F0F0F0F0F0F0F0F, 0x5A5A5A5A5A5A5A5A)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u long, v long): equal roots exactly for connected nodes.

    Each round points every node at its least neighbour, follows the pointers a few steps and contracts the graph; at least
    every node that is not a least one among its neighbours goes. Self-loops and repeated edges are ignored; no edges, no rows.
    The rows are a table of their own, so that plans over them stay small.
    """
    now = stage(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components-edges")
    steps = []
    while not now.isEmpty():
        salt = F.lit(SALTS[len(steps) % len(SALTS)]).cast("long")
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        to = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(salt)).alias("b"))
        to = to.select("a", F.least("b", F.col("a").bitwiseXOR(salt)).bitwiseXOR(salt).alias("t"))
        near = to = stage(to, "components-near")
        for _ in range(2):
            after = near.select(F.col("a").alias("t"), F.col("t").alias("t2"))
            to = to.join(after, "t").select("a", F.col("t2").alias("t"))
        to = stage(to, "components-step")
        drop(near)
        steps.append(to)
        left = to.select(F.col("a").alias("u"), F.col("t").alias("x"))
        right = to.select(F.col("a").alias("v"), F.col("t").alias("y"))
        new = now.join(left, "u").join(right, "v").where("x <> y")
        new = stage(new.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "components-edges")
        drop(now)
        now = new
    if not steps:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0].select(F.col("a").alias("node"), F.col("t").alias("root"))
    for to in steps[1:]:
        out = out.join(to, out["root"] == to["a"], "left").select("node", F.coalesce("t", "root").alias("root"))
    out = stage(out, "components")
    drop(now, *steps)
    return out
