"""Scalar expressions the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories whose files reports leave out.
IGNORE_DIRS = ("node_modules", "venv", ".venv", "env", ".env", "dist", "build", "target", "out", ".git", "__pycache__")


def in_repo(path: Column, repo: str | None, strict: bool = True) -> Column:
    """Whether a path is the repository's or below it; not strict: whether its text starts so, as '/a/repo2' does for '/a/repo'."""
    if not repo:
        return F.lit(True)
    repo = repo.rstrip("/")
    return (path == repo) | path.startswith(repo + "/") if strict else path.startswith(repo)


def ignored(path: Column, dirs: tuple[str, ...] = IGNORE_DIRS) -> Column:
    """Whether a path leads through one of the directories, with either separator."""
    out = F.lit(False)
    for d in dirs:
        out = out | path.contains(f"/{d}/") | path.contains(f"\\{d}\\")
    return out


def normalised_decorator(raw: Column) -> Column:
    """'@app.route("/x")' -> 'app.route'."""
    return F.split_part(F.regexp_replace(F.trim(raw), "^@+", ""), F.lit("("), F.lit(1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]+)?$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name_from_symbol(symbol: Column) -> Column:
    """The last name of a symbol such as 'pkg/mod/Class#method().'."""
    return F.regexp_extract(F.regexp_replace(symbol, r"[().]+$", ""), r"([^/#.`]*)`?$", 1)


def strip_prefix(path: Column, prefix: str = "/workspace/") -> Column:
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def elapsed(seconds: Column) -> Column:
    """'3m 7s'."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))


def common_prefix(low: Column, high: Column) -> Column:
    """The longest folder that the least and the greatest of some paths share; so all of them share it."""
    a, b = F.split(low, "/"), F.split(high, "/")
    n = F.least(F.size(a), F.size(b)) - 1
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda k, i: F.when((k == i) & (F.get(a, i) == F.get(b, i)) & (i < n), k + 1).otherwise(k))
    return F.array_join(F.slice(a, F.lit(1), same), "/")
