"""Source files as rows, with ignore rules."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.text import IGNORE_DIRS

#: Ignore patterns that hold where a repository has none of its own.
DEFAULT_PATTERNS = ("node_modules/", "venv/", ".venv/", "env/", ".env/", "dist/", "build/", "target/", "out/", ".git/", "__pycache__/", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg", "*.mp4", "*.mp3", "*.zip", "*.tar", "*.gz")
SUFFIXES = ("py", "ipynb", "rs")


def pattern_lines(text: str) -> list[str]:
    """The patterns of an ignore file: no blank lines and comments."""
    return [line.rstrip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]


def pattern_regex(pattern: str) -> tuple[str, bool]:
    """A gitignore pattern as a regular expression over a relative path, and whether it takes paths back in."""
    back = pattern.startswith("!")
    p = pattern[1:] if back else pattern
    p = p[1:] if p.startswith("\\") else p
    folder, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a relative path ignores it."""
    out = F.lit(False)
    for p in patterns:
        regex, back = pattern_regex(p)
        out = F.when(path.rlike(regex), F.lit(not back)).otherwise(out)
    return out


#: The name of ignore files.
IGNORE_FILE = ".srcgraphignore"


def find_ignore_file(root: str | Path, explicit: str | Path | None = None) -> Path | None:
    """The nearest ignore file from root up to the top of its git working tree; outside of one only root's own; else an explicit one."""
    root = Path(root).resolve()
    top = next((p for p in (root, *root.parents) if (p / ".git").exists()), root)
    for at in (root, *root.parents):
        if (at / IGNORE_FILE).is_file():
            return at / IGNORE_FILE
        if at == top:
            break
    return Path(explicit) if explicit and Path(explicit).is_file() else None


def ensure_ignore_file(root: str | Path, defaults: tuple[str, ...] = DEFAULT_PATTERNS) -> Path:
    """Root's ignore file, written with the default patterns if there is none."""
    path = Path(root) / IGNORE_FILE
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("# Patterns of files that are not indexed\n" + "\n".join(defaults) + "\n")
    return path


def ignore_patterns(root: str | Path, explicit: str | Path | None = None, defaults: tuple[str, ...] = DEFAULT_PATTERNS) -> list[str]:
    """The patterns that hold below root: of the nearest ignore file, or a new one, then an explicit one, then the defaults. The last that matches decides."""
    own = find_ignore_file(root) or ensure_ignore_file(root, defaults)
    found = pattern_lines(own.read_text())
    if explicit and Path(explicit).is_file() and Path(explicit).resolve() != own.resolve():
        found += pattern_lines(Path(explicit).read_text())
    return [*found, *defaults]


def file_text(spark: SparkSession, path: str) -> str:
    """The text of one file, read as Spark reads it, so from any store."""
    row = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("text")).first()
    return "" if row is None else row["text"]


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, ignore_dirs: tuple[str, ...] = IGNORE_DIRS, max_mb: float | None = None, hidden: bool = True, tests: bool = True, max_depth: int | None = None) -> DataFrame:
    """Files of supported kinds below root: path, relative_path, text. Folder names of ignore_dirs count in any case.

    Names and sizes decide before contents are read: the filters are on the file listing's columns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:/{0,2}(?=/)", "")
    base = root.split("://")[-1].rstrip("/")
    relative = F.expr(f"substring(path, {len(base) + 2})")
    files = files.withColumn("path", path)
    files = files.withColumn("relative_path", relative)
    folders = F.slice(F.split("relative_path", "/"), F.lit(1), F.size(F.split("relative_path", "/")) - 1)
    if ignore_dirs:
        files = files.where(~F.arrays_overlap(F.transform(folders, F.lower), F.array(*[F.lit(d.lower()) for d in ignore_dirs])))
    files = files.where(~ignored_by(F.col("relative_path"), list(DEFAULT_PATTERNS if patterns is None else patterns)))
    if not hidden:
        files = files.where(~F.exists(F.split("relative_path", "/"), lambda p: p.startswith(".")))
    if not tests:
        files = files.where(~F.element_at(F.split("relative_path", "/"), -1).rlike(r"^test_|_test\.[a-z]+$"))
    if max_depth is not None:
        files = files.where(F.size(folders) <= max_depth)
    if max_mb:
        files = files.where(F.col("length") <= int(max_mb * 1024 * 1024))
    return files.select("path", "relative_path", F.decode("content", "UTF-8").alias("text"))


def git_log(text: DataFrame) -> DataFrame:
    """Lines of `git log --numstat` with '@author|email|ts' headers (id, line, in order) as commits with their sums; '-' counts 0."""
    from pyspark.sql import Window as W

    head = F.split(F.expr("substring(line, 2)"), r"\|")
    rows = text.where("line <> ''").withColumn("commit", F.sum(F.col("line").startswith("@").cast("int")).over(W.partitionBy("log").orderBy("id")))
    n = lambda i: F.coalesce(F.expr(f"try_cast(split(line, '\t')[{i}] as bigint)"), F.lit(0))
    changes = rows.where(~F.col("line").startswith("@")).groupBy("log", "commit").agg(F.sum(n(0)).alias("added"), F.sum(n(1)).alias("deleted"))
    heads = rows.where(F.col("line").startswith("@")).select("log", "commit", head[0].alias("author"), head[1].alias("email"), head[2].alias("ts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return heads.join(changes, ["log", "commit"], "left").select("author", "email", "ts", zero("added"), zero("deleted"))
