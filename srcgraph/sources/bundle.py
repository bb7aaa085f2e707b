"""Graph snapshots as folders of JSON lines: nodes, edges, metadata and counts."""

from __future__ import annotations

import urllib.request
import zipfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.text import in_repo
from srcgraph.graph import EDGE_COLUMNS, KEYS, NODE_COLUMNS, SYMBOL_KEY, PropertyGraph, node_id
from srcgraph.operators.quality import edge_histogram, label_histogram

VERSION = "1"
PROPERTIES = ", ".join(f"{c} {t}" for c, t in EDGE_COLUMNS.items() if c not in ("src", "dst", "type"))
NODES = ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items() if c not in ("id", "label")) + ", _id string, _labels array<string>"
EDGES = f"`from` string, `to` string, type string, properties struct<{PROPERTIES.replace(' array', ': array').replace(' string', ': string').replace(' int', ': int')}>"


def commit_of(repo: str | None) -> str | None:
    """The first digits of the commit that a local repository stands at, read from its files."""
    head = Path(repo or "") / ".git" / "HEAD"
    if not repo or not head.is_file():
        return None
    text = head.read_text().strip()
    ref = head.parent / text.removeprefix("ref: ")
    return (ref.read_text().strip() if text.startswith("ref: ") and ref.is_file() else "" if text.startswith("ref: ") else text)[:8] or None


def schema_of(g: PropertyGraph) -> DataFrame:
    """What a snapshot's labels and types are known by: (what, name, key)."""
    rows = [("node", x, list(KEYS.get(x, SYMBOL_KEY))) for x in g.nodes] + [("edge", x, ["src", "dst"]) for x in g.edges]
    return g.spark.createDataFrame(rows, "what string, name string, key array<string>")


def readme_of(name: str, exported: str, counts: DataFrame) -> str:
    rows = counts.orderBy("what", F.desc("n"), "name").collect()  # at most the known labels and types
    return f"Snapshot of {name}, made {exported}\n\n" + "".join(f"{r['what']} {r['name']}: {r['n']}\n" for r in rows)


def archive(path: str, target: str) -> str:
    """A local snapshot folder as one zip file."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(p for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))):
            z.write(f, f.relative_to(path))
    return target


def unpack(archive_path: str, target: str) -> str:
    """The snapshot folder of a zip file; names that lead out of it are refused."""
    with zipfile.ZipFile(archive_path) as z:
        root = Path(target).resolve()
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} leads out of the archive")
        z.extractall(root)
    return target


def download(url: str, target: str, block: int = 1 << 20) -> str:
    """Fetches a file in blocks; nothing is left behind if that fails."""
    part = Path(f"{target}.part")
    try:
        with urllib.request.urlopen(url) as source, part.open("wb") as out:
            while data := source.read(block):
                out.write(data)
        part.replace(target)
    except Exception:
        part.unlink(missing_ok=True)
        raise
    return target


def clear(g: PropertyGraph, repo: str | None = None) -> PropertyGraph:
    """The graph without a repository, or empty."""
    from srcgraph.operators.maintain import delete_repository

    return delete_repository(g, repo) if repo else PropertyGraph(g.spark)


def export(g: PropertyGraph, path: str, repo: str | None = None) -> None:
    """Nodes of a repository, or all, and edges with either end among them, with metadata, keys, counts and a text about them.

    Nodes without a path, as modules, belong to no repository.
    """
    nodes = g.all_nodes()
    edges = g.all_edges()
    if repo:
        nodes = nodes.where(F.col("path").isNotNull() & in_repo(F.col("path"), repo))
        ids = nodes.select("id")
        near = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))
        edges = near
    nodes.select(*[c for c in NODE_COLUMNS if c not in ("id", "label")], F.col("id").alias("_id"), F.array("label").alias("_labels")).write.mode("overwrite").json(f"{path}/nodes")
    edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "type", F.struct(*[c for c in EDGE_COLUMNS if c not in ("src", "dst", "type")]).alias("properties")).write.mode("overwrite").json(f"{path}/edges")
    now = datetime.now(timezone.utc).isoformat()
    found = g.node("Repository").where(F.col("path") == repo).select("name", "is_dependency").first() if repo else None
    facts = (VERSION, now, repo, found["name"] if found else None, found["is_dependency"] if found else None, commit_of(repo))
    meta = g.spark.createDataFrame([facts], "version string, exported_at string, repo string, name string, is_dependency boolean, commit string")
    schema_of(g).coalesce(1).write.mode("overwrite").json(f"{path}/schema")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    stats = label_histogram(g).select(F.lit("node").alias("what"), F.col("label").alias("name"), "n").unionByName(edge_histogram(g).select(F.lit("edge").alias("what"), F.col("type").alias("name"), "n"))
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    text = readme_of(facts[3] or repo or "all repositories", now, g.spark.read.schema("what string, name string, n long").json(f"{path}/stats"))
    g.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/README")


def load(spark: SparkSession, path: str, into: PropertyGraph | None = None) -> PropertyGraph:
    """The graph of a snapshot, merged into another by node keys; edges without both ends are left out, and a repository that is there already is refused."""
    meta = spark.read.schema("version string, repo string").json(f"{path}/metadata").first()
    if meta is None or meta["version"] != VERSION:
        raise ValueError("not a snapshot of a known version")
    nodes = spark.read.schema(NODES).json(f"{path}/nodes").withColumn("label", F.col("_labels")[0])
    edges = spark.read.schema(EDGES).json(f"{path}/edges")
    labels = [r[0] for r in nodes.select("label").distinct().collect()]  # at most the known labels
    g, ids = into or PropertyGraph(spark), []
    if into is not None and "Repository" in labels and not nodes.where("label = 'Repository'").join(into.node("Repository").select("path"), "path", "left_semi").isEmpty():
        raise ValueError("the repository is in the graph already")
    for label in labels:
        own = nodes.where(F.col("label") == label)
        ids.append(own.select("_id", node_id(label).alias("id")))
        columns = [c for c in NODE_COLUMNS if c not in ("id", "label")]
        g = g.upsert_nodes(label, own.select(*columns))
    if not ids:
        return g
    known = ids[0]
    for x in ids[1:]:
        known = known.unionByName(x)
    known = known.distinct()
    mapped = edges.join(known.select(F.col("_id").alias("from"), F.col("id").alias("src")), "from").join(known.select(F.col("_id").alias("to"), F.col("id").alias("dst")), "to").select("src", "dst", "type", "properties.*")
    for (kind,) in mapped.select("type").distinct().collect():  # at most the known types
        rows = mapped.where(F.col("type") == kind).drop("type")
        old = g.edges.get(kind)
        g.edges[kind] = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    return g
