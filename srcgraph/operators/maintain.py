"""Deleting and cleaning: a graph without what goes, as a new graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import in_repo
from srcgraph.graph import PropertyGraph
from srcgraph.operators.traverse import cut, reachable


def without(g: PropertyGraph, gone: DataFrame) -> PropertyGraph:
    """The graph without the nodes gone (id) and their edges. gone is worked out once, not for each label and type."""
    ids = cut(gone.select("id").distinct())
    src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
    return PropertyGraph(g.spark, {k: v.join(ids, "id", "left_anti") for k, v in g.nodes.items()}, {k: v.join(src, "src", "left_anti").join(dst, "dst", "left_anti") for k, v in g.edges.items()})


def delete_file(g: PropertyGraph, path: str) -> PropertyGraph:
    """Without a file, what it directly contains, and folders that are left empty, deepest first."""
    f = g.node("File").where(F.col("path") == path).select("id")
    inside = g.edge("CONTAINS").join(f.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    new = without(g, f.unionByName(inside))
    for _ in range(path.count("/")):
        # only folders above the file can have become empty
        above = new.node("Directory").where(F.lit(path).startswith(F.concat("path", F.lit("/"))))
        empty = above.join(new.edge("CONTAINS").select(F.col("src").alias("id")), "id", "left_anti").select("id")
        if empty.isEmpty():
            break
        new = without(new, empty)
    return new


def delete_repository(g: PropertyGraph, repo: str) -> PropertyGraph:
    """Without a repository and everything at or below its path."""
    return without(g, g.all_nodes().where(F.col("path").isNotNull() & in_repo(F.col("path"), repo)))


def delete_calls_from(g: PropertyGraph, paths: DataFrame) -> PropertyGraph:
    """Without the calls whose source is in one of the files (path)."""
    ids = g.all_nodes(tuple(x for x in ("Function", "Class", "File") if x in g.nodes)).join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("src"))
    return PropertyGraph(g.spark, g.nodes, g.edges | {"CALLS": g.edge("CALLS").join(ids, "src", "left_anti")})


def delete_inherits_of(g: PropertyGraph, paths: DataFrame) -> PropertyGraph:
    """Without inheritance edges with either end in one of the files (path)."""
    ids = g.node("Class").join(paths.select("path"), "path", "left_semi").select("id")
    e = g.edge("INHERITS").join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return PropertyGraph(g.spark, g.nodes, g.edges | {"INHERITS": e})


def delete_links(g: PropertyGraph, repo: str | None = None) -> tuple[PropertyGraph, DataFrame]:
    """Without the calls and inheritance that start in a repository, or in any; and how many of each type went."""
    ids = g.all_nodes(tuple(x for x in ("Function", "Class", "File") if x in g.nodes)).where(in_repo(F.col("path"), repo)).select(F.col("id").alias("src"))
    edges, counts = dict(g.edges), []
    for kind in ("CALLS", "INHERITS"):
        e = g.edge(kind)
        edges[kind] = e.join(ids, "src", "left_anti")
        counts.append(e.join(ids, "src", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("type"), "n"))
    return PropertyGraph(g.spark, g.nodes, edges), counts[0].unionByName(counts[1])


def reindex(g: PropertyGraph, files: DataFrame, root: str, name: str | None = None, is_dependency: bool = False) -> PropertyGraph:
    """The graph with a repository read anew: what it held goes, what its files hold now comes."""
    from srcgraph.operators.resolve import index_repository

    return merged(delete_repository(g, root.rstrip("/")), index_repository(files, root, name, is_dependency))


def merged(g: PropertyGraph, new: PropertyGraph) -> PropertyGraph:
    """Both graphs as one; of nodes with one id and of equal edges one stays."""

    def both(old: dict, more: dict, key: list[str] | None) -> dict:
        out = dict(old) | {k: v for k, v in more.items() if k not in old}
        for k in old.keys() & more.keys():
            every = old[k].unionByName(more[k], allowMissingColumns=True)
            out[k] = every.dropDuplicates(key) if key else every.distinct()
        return out

    return PropertyGraph(g.spark, both(g.nodes, new.nodes, ["id"]), both(g.edges, new.edges, None))


def delete_all(g: PropertyGraph, confirmed: int = 0) -> PropertyGraph:
    """Nothing left of any repository. Asks to be confirmed twice, as this can't be taken back."""
    if confirmed < 2:
        raise PermissionError("deleting every repository must be confirmed twice")
    return PropertyGraph(g.spark)


def clean(g: PropertyGraph) -> PropertyGraph:
    """Without symbols, files and folders that nothing contains, again and again until none is left. Repositories, and modules, parameters and decorators with edges, stay."""
    # what peeling leaves is what a repository still leads to; peeling would also keep cycles, which containment has none of
    kept = reachable(g.node("Repository"), g.edge("CONTAINS"), with_start=True).select("id")
    contained = tuple(x for x in g.nodes if x not in ("Repository", "Module", "Parameter", "Decorator"))
    gone = g.all_nodes(contained).join(kept, "id", "left_anti").select("id")
    new = without(g, gone)
    loose = tuple(x for x in ("Module", "Parameter", "Decorator") if x in new.nodes)
    if not loose:
        return new
    ends = new.all_edges().select(F.explode(F.array("src", "dst")).alias("id"))
    return without(new, new.all_nodes(loose).join(ends, "id", "left_anti"))


def indexed_files(g: PropertyGraph, repo: str) -> DataFrame:
    """How many files a repository leads to; over 0 if it is indexed."""
    return g.node("File").where(in_repo(F.col("path"), repo)).agg(F.countDistinct("path").alias("n_files"))
