"""Shuffles begin with as many partitions as the tables ask for."""

from srcgraph.plans import project

SF = "/root/testdata/sf0.001"


def test_partitions_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(project, "SHARE", 1 << 10)
    project.graph(spark, SF)
    assert int(spark.conf.get(project.INITIAL)) > 20
    monkeypatch.setattr(project, "SHARE", 1 << 30)
    project.graph(spark, SF)
    assert spark.conf.get(project.INITIAL, None) is None
    spark.conf.set(project.INITIAL, "7")
    monkeypatch.setattr(project, "SHARE", 1 << 10)
    project.graph(spark, SF)
    assert spark.conf.get(project.INITIAL) == "7"
    spark.conf.unset(project.INITIAL)
