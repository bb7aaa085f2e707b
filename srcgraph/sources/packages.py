"""Where installed packages have their sources, by language, and projects below a folder."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDERS: dict[str, Callable[[str, Path], Path | None]] = {}
#: Files that make a folder a project.
MARKERS = ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Cargo.toml", "package.json", "go.mod", "pom.xml", "build.gradle", ".git")


def finder(*languages: str):
    def register(f):
        FINDERS.update(dict.fromkeys(languages, f))
        return f

    return register


@finder("python")
def python_package(name: str, start: Path) -> Path | None:
    """The folder of a package, or the file of a module that is alone; nothing is imported but parents of dotted names."""
    try:
        spec = importlib.util.find_spec(name)
    except (ImportError, ValueError):
        return None
    if spec is None:
        return None
    if spec.submodule_search_locations:
        return Path(next(iter(spec.submodule_search_locations)))
    return Path(spec.origin) if spec.origin and spec.has_location else None


@finder("javascript", "typescript")
def node_package(name: str, start: Path) -> Path | None:
    """The nearest node_modules upwards that has it."""
    return next((p / "node_modules" / name for p in (start, *start.parents) if (p / "node_modules" / name).is_dir()), None)


@finder("rust")
def rust_crate(name: str, start: Path) -> Path | None:
    """The newest by name among sources that the package manager keeps in the home folder."""
    found = sorted((Path.home() / ".cargo" / "registry" / "src").glob(f"*/{name}-[0-9]*"))
    return found[-1] if found else None


@finder("go")
def go_module(name: str, start: Path) -> Path | None:
    found = sorted((Path.home() / "go" / "pkg" / "mod").glob(f"{name}@*"))
    return found[-1] if found else None


def package_path(name: str, language: str = "python", start: str | Path = ".") -> str | None:
    """Where a package's sources are, or None. ValueError for a language without a finder."""
    find = FINDERS.get(language.lower())
    if find is None:
        raise ValueError(f"no way to find packages of {language!r}; known are {', '.join(sorted(FINDERS))}")
    found = find(name, Path(start).resolve())
    return None if found is None else str(found)


def projects(root: str | Path, max_depth: int = 2) -> list[str]:
    """Folders up to so many levels below root with a marker file; what is below a project belongs to it."""
    found, level = [], [Path(root).resolve()]
    for _ in range(max_depth + 1):
        below = []
        for at in level:
            if any((at / m).exists() for m in MARKERS):
                found.append(str(at))
            else:
                below += [p for p in sorted(at.iterdir()) if p.is_dir() and not p.name.startswith(".")]
        level = below
    return found


def index_projects(spark: SparkSession, root: str | Path, target: str, max_depth: int = 2) -> DataFrame:
    """Indexes every project below a folder to a graph of its own under target; name, path, files, functions and classes of each."""
    from srcgraph.graph import PropertyGraph
    from srcgraph.operators.resolve import index_repository
    from srcgraph.sources.files import scan

    rows = []
    for path in projects(root, max_depth):
        name = path.rsplit("/", 1)[-1]
        at = f"{target}/{len(rows):04d}-{name}"
        index_repository(scan(spark, path), path, name).write(at)
        g = PropertyGraph.read(spark, at)
        n = {r["label"]: r["count"] for r in g.all_nodes(("File", "Function", "Class")).groupBy("label").count().collect()}
        rows.append((name, path, at, n.get("File", 0), n.get("Function", 0), n.get("Class", 0)))
    return spark.createDataFrame(rows, "name string, path string, graph string, files long, functions long, classes long").orderBy(F.col("path"))
