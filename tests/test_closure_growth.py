"""Levels of closures don't pass through the driver."""

from pyspark.sql import functions as F

from srcgraph.graph import PropertyGraph
from srcgraph.operators import traverse


def test_levels_are_not_broadcast(spark, monkeypatch):
    plans, write = [], traverse.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(traverse, "cut", cut)
    ids = spark.range(1, 30).select(F.concat(F.lit("c"), "id").alias("id"))
    edges = spark.range(2, 30).select(F.concat(F.lit("c"), "id").alias("src"), F.concat(F.lit("c"), F.floor(F.col("id") / 2)).alias("dst"))
    g = PropertyGraph(spark, {"Class": ids}, {"INHERITS": edges})
    assert {(r["id"], r["depth"]) for r in traverse.inheritance_depth(g).collect()} == {(f"c{i}", i.bit_length() - 1) for i in range(1, 30)}
    assert not [p for p in plans if "Broadcast" in p]
