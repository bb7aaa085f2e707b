"""Indexing as background jobs: a folder, a package, a snapshot."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from srcgraph.graph import PropertyGraph
from srcgraph.operators import maintain
from srcgraph.operators.resolve import index_repository
from srcgraph.service.jobs import JobLog, estimate
from srcgraph.service.settings import Settings
from srcgraph.sources import bundle
from srcgraph.sources.files import scan
from srcgraph.sources.packages import package_path


class Store:
    """A stored graph that jobs add repositories to. Each change is a new version beside the one before; a pointer names the current one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    def graph(self) -> PropertyGraph:
        at = self._current()
        return PropertyGraph(self.spark) if at is None else PropertyGraph.read(self.spark, str(at))

    def _current(self) -> Path | None:
        pointer = self.folder / "CURRENT"
        return self.folder / pointer.read_text().strip() if pointer.is_file() else None

    def put(self, g: PropertyGraph) -> PropertyGraph:
        self.folder.mkdir(parents=True, exist_ok=True)
        old = self._current()
        name = f"v{int(old.name[1:]) + 1 if old else 1:06d}"
        g.write(str(self.folder / name))
        (self.folder / "NEXT").write_text(name)
        (self.folder / "NEXT").replace(self.folder / "CURRENT")
        return self.graph()


def add_code(log: JobLog, store: Store, path: str, is_dependency: bool = False, settings: Settings | None = None) -> dict:
    """Starts to index a folder; the job's id, how many files there are and the seconds they may take.

    A folder that is not there, one that is indexed already and one with a job under way are refused.
    """
    root = Path(path).resolve()
    if not root.exists():
        raise FileNotFoundError(f"no folder {root}")
    g = store.graph()
    if "Repository" in g.nodes and not g.node("Repository").where(F.col("path") == str(root)).isEmpty() and maintain.indexed_files(g, str(root)).first()["n_files"]:
        raise ValueError(f"{root} is indexed already")
    n, seconds = estimate(store.spark, str(root))
    options = settings.scan_options() if settings else {}
    skip = bool(settings and settings.flag("SKIP_EXTERNAL_RESOLUTION"))
    sources = not settings or settings.flag("INDEX_SOURCE")

    def work(progress) -> PropertyGraph:
        new = index_repository(scan(store.spark, str(root), **options), str(root), root.name, is_dependency, skip, sources)
        if settings and not settings.flag("INDEX_VARIABLES"):
            new = maintain.without(new, new.node("Variable").select("id"))
        out = store.put(maintain.merged(store.graph(), new))
        progress(n)
        return out

    return {"job_id": log.start(str(root), work, is_dependency, n), "files": n, "seconds": seconds}


def add_package(log: JobLog, store: Store, name: str, language: str = "python", settings: Settings | None = None) -> dict:
    """Starts to index the sources of an installed package, as a dependency."""
    path = package_path(name, language)
    if path is None:
        raise FileNotFoundError(f"no sources of {language} package {name!r}")
    return add_code(log, store, path, True, settings)


def load_bundle(store: Store, archive: str, folder: str, clear: bool = False) -> PropertyGraph:
    """Adds the graph of an archive, unpacked to folder, to the stored one, or puts it in its place."""
    into = None if clear else store.graph()
    return store.put(bundle.load(store.spark, bundle.unpack(archive, folder), into))
