"""File-change events: which count, how they are debounced, and what they change in a stored graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.extract import parsed
from srcgraph.graph import PropertyGraph
from srcgraph.operators import maintain
from srcgraph.operators.resolve import linked, symbol_graph
from srcgraph.operators.traverse import cut

#: Files that are indexed, and what events mean.
SUFFIXES = (".py", ".ipynb", ".rs")
KINDS = {"created": "created", "modified": "modified", "renamed": "modified", "removed": "removed"}
GAP = "2 seconds"
#: What the names of watching queries begin with.
WATCH = "watch_"


def mapped(events: DataFrame, suffixes: tuple[str, ...] | None = SUFFIXES) -> DataFrame:
    """Events (ts, kind, path) of supported files and kinds; a rename is a change."""
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KINDS.items()])
    out = events.withColumn("kind", kind).where("kind is not null")
    return out.where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*suffixes)) if suffixes else out


def debounced(events: DataFrame, gap: str = GAP, late: str | None = None) -> DataFrame:
    """One row for each burst of events of a path, closed when the path is quiet for the gap: start, end, n_events, last action.

    late: how much later than the newest an event of a stream may come; sessions older than that are final.
    """
    if late:
        events = events.withWatermark("ts", late)
    by = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max_by("kind", "ts").alias("action"))
    return by.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "action")


def events_of(table: DataFrame) -> DataFrame:
    """The test table of events as file events."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "removed").otherwise("modified")
    return table.select("ts", kind.alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"))


def watch(events: DataFrame, relink: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP, late: str = "10 seconds", name: str | None = None):
    """Starts a query that hands each batch of closed bursts (path, action) to relink, which reads the paths' state of now, so that repeats do no harm."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        relink(batch.groupBy("path").agg(F.max_by("action", "end").alias("action")), batch_id)

    writer = debounced(mapped(events), gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.queryName(WATCH + name) if name else writer).start()


def relinked(graph: PropertyGraph, changed: DataFrame, read: Callable[[DataFrame], DataFrame], root: str, skip_external: bool = False) -> PropertyGraph:
    """The graph after files (path, action) changed: what they held goes, what they hold now comes, and calls and bases are linked again.

    read(paths) gives the files (path, relative_path, text) that are still there of those asked for. Linked again are the changed
    files and those whose calls or bases led into them, all against the symbols of the whole graph as it is after the change.
    Who these are is found before anything is deleted. Doing it twice gives the same graph.
    """
    symbols = graph.all_nodes(tuple(x for x in ("Function", "Class", "File") if x in graph.nodes)).where("path is not null").select("id", "path")
    paths = cut(changed.groupBy("path").agg(F.max("action").alias("action")))
    own = symbols.join(paths, "path", "left_semi").select("id")
    met = graph.pairs("CALLS").unionByName(graph.pairs("INHERITS")).join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    near = cut(symbols.join(met, "id", "left_semi").select("path").distinct().join(paths, "path", "left_anti"))
    rows = cut(parsed(read(paths.select("path").unionByName(near))))
    gone = graph.all_nodes().where("path is not null").join(paths, "path", "left_semi").select("id")
    fresh = rows.join(paths, "path", "left_semi")
    old = maintain.without(graph, gone)
    # what neighbours' calls and bases led to is worked out anew
    again = graph.all_nodes(tuple(x for x in ("Function", "Class", "File") if x in graph.nodes)).join(near, "path", "left_semi").select(F.col("id").alias("src"))
    again = cut(again)
    edges = {k: e.join(again, "src", "left_anti") if k in ("CALLS", "INHERITS") else e for k, e in old.edges.items()}
    new = maintain.merged(PropertyGraph(graph.spark, old.nodes, edges), symbol_graph(fresh, root.rstrip("/")))
    new = PropertyGraph(graph.spark, graph.nodes | new.nodes | {"Repository": graph.node("Repository")} if "Repository" in graph.nodes else new.nodes, new.edges)
    return maintain.merged(new, linked(rows, new, skip_external))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below root with the time of their last change, from the file listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(s[1:] for s in SUFFIXES) + "}").load(root)
    return files.select(F.regexp_replace("path", "^[a-z0-9]+:/{0,2}(?=/)", "").alias("path"), F.col("modificationTime").alias("ts"), "length")


def events_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """File events (ts, kind, path) that lead from one listing to a later one: created, modified by time or length, removed."""
    b, a = before.select("path", F.col("ts").alias("was"), F.col("length").alias("had")), after.select("path", "ts", "length")
    x = a.join(b, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("ts").isNull(), "removed").when((F.col("ts") != F.col("was")) | (F.col("length") != F.col("had")), "modified")
    return x.select(F.coalesce("ts", F.current_timestamp()).alias("ts"), kind.alias("kind"), "path").where("kind is not null")


def initial_scan(spark: SparkSession, root: str, stored: PropertyGraph | None = None, name: str | None = None) -> PropertyGraph:
    """The graph to begin watching with: the stored one if it has files of the repository, else one of all its files."""
    from srcgraph.operators.resolve import index_repository
    from srcgraph.sources.files import scan

    if stored is not None and (maintain.indexed_files(stored, root).first()["n_files"] or 0) > 0:
        return stored
    return index_repository(scan(spark, root), root, name)


def watched(spark: SparkSession) -> list[str]:
    """The names of the folders' queries that run in this session."""
    return sorted(q.name for q in spark.streams.active if q.name and q.name.startswith(WATCH))


def unwatch(spark: SparkSession, name: str) -> bool:
    """Stops the query of a folder; whether there was one."""
    found = [q for q in spark.streams.active if q.name == WATCH + name]
    for q in found:
        q.stop()
    return bool(found)
