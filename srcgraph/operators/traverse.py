"""Traversals: closures by frontier joins, call chains as trails, containment as path counts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.text import in_repo
from srcgraph.graph import PropertyGraph
from srcgraph.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder all executors share, so that a loop's plan stays short and survives lost executors."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/traverse-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_cut_at", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def reachable(start: DataFrame, edges: DataFrame, with_start: bool = False, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of what edges (src, dst) lead to from start (id). Without with_start, a start only counts if it is on a cycle.

    The distinct edges are worked out once. Each round joins the newest nodes to them and drops what is known; rounds are as many
    as the farthest node is away. The rounds' tables go when the result, a table of its own, is written.
    """
    edges = cut(edges.select("src", "dst").distinct())
    first = frontier = cut(start.select("id").distinct())
    levels = [frontier.select("id", F.lit(0).alias("depth"))] if with_start else []
    tables, depth = [edges, first], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = edges.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        for level in levels:
            new = new.join(level.select("id"), "id", "left_anti")
        frontier = cut(new)
        tables.append(frontier)
        if frontier.isEmpty():
            break
        levels.append(frontier.select("id", F.lit(depth).alias("depth")))
    found = reduce(DataFrame.unionByName, levels) if levels else first.select("id", F.lit(0).alias("depth")).limit(0)
    found = cut(found)
    drop(*tables)
    return found


def _closure(g: PropertyGraph, name: str, path: str | None, repo: str | None, backward: bool, n: int | None) -> DataFrame:
    start = g.node("Function").where((F.col("name") == name) & (F.lit(True) if path is None else F.col("path") == path))
    edges = g.edge("CALLS").select("src", "dst")
    if backward:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = g.node("Function").where(in_repo(F.col("path"), repo)).join(reachable(start, edges), "id")
    found = found.select("name", "path", "line_number", "is_dependency", "depth").orderBy("is_dependency", "path", "line_number")
    return found.limit(n) if n else found


def all_callers(g: PropertyGraph, name: str, path: str | None = None, repo: str | None = None, n: int | None = 50) -> DataFrame:
    return _closure(g, name, path, repo, True, n)


def all_callees(g: PropertyGraph, name: str, path: str | None = None, repo: str | None = None, n: int | None = 50) -> DataFrame:
    return _closure(g, name, path, repo, False, n)


def call_chains(g: PropertyGraph, start: str, end: str, max_depth: int = 5, start_path: str | None = None, end_path: str | None = None, n: int | None = 20, repo: str | None = None) -> DataFrame:
    """Trails of calls, no call twice, from a function of one name to one of another, of 1 to max_depth calls, short ones first.

    repo: only trails through functions of this repository.

    Trails grow only along edges from which an end is still within reach, and only until n are found: longer ones come later.
    """
    f = g.node("Function").where(in_repo(F.col("path"), repo)).select("id", "name", "path")
    at = lambda name, path: f.where((F.col("name") == name) & (F.lit(True) if path is None else F.col("path") == path))
    eid = F.concat_ws("|", "src", "dst", F.col("line_number").cast("string"), F.array_join("args", ","), "full_call_name")
    edges = g.edge("CALLS").select("src", "dst", eid.alias("eid"))
    edges = edges if repo is None else edges.join(f.select(F.col("id").alias("src")), "src", "left_semi").join(f.select(F.col("id").alias("dst")), "dst", "left_semi")
    back = reachable(at(end, end_path), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), True, max_depth - 1)
    edges = edges.join(back.select(F.col("id").alias("dst"), F.col("depth").alias("left")), "dst")
    ends = at(end, end_path).select(F.col("id").alias("last"))
    trails = at(start, start_path).select(F.col("id").alias("last"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("calls"))
    found = None
    for depth in range(1, max_depth + 1):
        step = trails.join(edges.where(F.col("left") <= max_depth - depth), F.col("last") == F.col("src")).where(~F.array_contains("calls", F.col("eid")))
        trails = cut(step.select(F.col("dst").alias("last"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("calls", F.array("eid")).alias("calls")))
        hits = trails.join(ends, "last", "left_semi").select(F.lit(depth).alias("chain_length"), "nodes", "calls")
        found = hits if found is None else found.unionByName(hits)
        if trails.isEmpty() or n and found.limit(n).count() == n:
            break
    found = found.select("chain_length", F.array_join("nodes", ">").alias("nodes"), F.array_join("calls", ">").alias("calls")).orderBy("chain_length", "nodes", "calls")
    return found.limit(n) if n else found


def containment_counts(g: PropertyGraph, root_label: str = "Repository") -> DataFrame:
    """(root, id, n_paths): along how many paths of CONTAINS each root leads to each node. The relation has no cycles."""
    edges = g.pairs("CONTAINS").select("src", "dst")
    level = cut(edges.join(g.node(root_label).select(F.col("id").alias("src")), "src").groupBy(F.col("src").alias("root"), F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    total = level
    while True:
        level = cut(level.join(edges, level["id"] == edges["src"]).groupBy("root", F.col("dst").alias("id")).agg(F.sum("n").alias("n")))
        if level.isEmpty():
            return total.groupBy("root", "id").agg(F.sum("n").alias("n_paths"))
        total = total.unionByName(level)


def subgraph(g: PropertyGraph, repo: str) -> DataFrame:
    """Everything a repository contains, itself included, with its outgoing edges."""
    start = g.node("Repository").where(F.col("path") == repo)
    ids = reachable(start, g.pairs("CONTAINS"), with_start=True).select("id")
    nodes = g.all_nodes().join(ids, "id").select("id", "label", "name", F.when(F.col("label").isin("Repository", "Class", "Interface", "Trait"), 4).otherwise(2).alias("val"))
    out = nodes.join(g.all_edges().select(F.col("src").alias("id"), "dst", F.col("type").alias("edge_type")).distinct(), "id", "left")
    return out.orderBy("id", "edge_type", "dst")


def inheritance_depth(g: PropertyGraph) -> DataFrame:
    """(id, depth): the longest way up from each class; 0 without a parent. Levels of longest ways only, so ways don't multiply.

    Merge joins: broadcasts of every round would pass through the driver.
    """
    edges = cut(g.pairs("INHERITS").select("src", "dst").distinct())
    level = cut(g.node("Class").select("id", F.lit(0).alias("depth")))
    best, depth, most = level, 0, level.count()
    while True:
        depth += 1
        level = cut(edges.join(level.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().select("id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return best.groupBy("id").agg(F.max("depth").alias("depth"))
        if depth >= most:  # a way through every class and one more goes round a cycle
            raise ValueError("classes inherit from each other in a circle")
        best = best.unionByName(level)
