"""Dead code, complexity, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import ignored, in_repo, normalised_decorator
from srcgraph.graph import PropertyGraph

#: Names that something outside the code may call.
ENTRY_NAMES = ("main", "setup", "run")
ENTRY_PARTS = ("application", "entry", "entrypoint")


def dead_code(g: PropertyGraph, exclude_decorators: tuple[str, ...] = (), repo: str | None = None, n: int | None = 50) -> DataFrame:
    """Own functions that no own function calls, without entry points, tests, dunders and ignored folders; decorators by raw or bare name."""
    name, low = F.col("name"), F.lower("name")
    f = g.node("Function").where(~F.col("is_dependency") & ~ignored(F.col("path")) & in_repo(F.col("path"), repo))
    own = f.where(~name.isin(*ENTRY_NAMES) & ~(name.startswith("__") & name.endswith("__")) & ~name.startswith("_test") & ~name.startswith("test_") & ~name.contains("main"))
    for part in ENTRY_PARTS:
        own = own.where(~low.contains(part))
    if exclude_decorators:
        unwanted = [*exclude_decorators]
        own = own.where(~F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.isin(*unwanted) | normalised_decorator(d).isin(*unwanted)))
    callers = g.node("Function").where(~F.col("is_dependency") & ~ignored(F.col("path"))).select(F.col("id").alias("src"))
    called = g.edge("CALLS").join(callers, "src", "left_semi").select(F.col("dst").alias("id"))
    found = own.join(called, "id", "left_anti").select("name", "path", "line_number").orderBy("path", "line_number", "name")
    return found.limit(n) if n else found


def complexity_of(g: PropertyGraph, function: str, path: str | None = None, repo: str | None = None) -> DataFrame:
    f = g.node("Function").where((F.col("name") == function) & in_repo(F.col("path"), repo) & (F.lit(True) if path is None else F.col("path").endswith(path)))
    return f.select("name", "path", "line_number", "cyclomatic_complexity").orderBy("path", "line_number").limit(1)


def most_complex(g: PropertyGraph, n: int = 10, repo: str | None = None) -> DataFrame:
    f = g.node("Function").where(F.col("cyclomatic_complexity").isNotNull() & ~F.col("is_dependency") & ~ignored(F.col("path")) & in_repo(F.col("path"), repo))
    return f.select("name", "path", "line_number", "cyclomatic_complexity").orderBy(F.desc("cyclomatic_complexity"), "path", "line_number").limit(n)


def complexity_bands(g: PropertyGraph, threshold: int = 10) -> DataFrame:
    """How many functions are above the threshold (red), above half of it (yellow) and below (green)."""
    c = F.col("cyclomatic_complexity")
    band = F.when(c > threshold, "red").when(c > threshold / 2, "yellow").otherwise("green")
    return g.node("Function").where(c.isNotNull() & ~F.col("is_dependency")).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c > threshold).alias("n_exceed"))


def label_histogram(g: PropertyGraph) -> DataFrame:
    return g.all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def edge_histogram(g: PropertyGraph) -> DataFrame:
    return g.all_edges().groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def overall_stats(g: PropertyGraph) -> DataFrame:
    """One row of counts."""
    kinds = {"Repository": "repositories", "File": "files", "Function": "functions", "Class": "classes", "Module": "modules"}
    return g.all_nodes(tuple(kinds)).agg(*[F.count_if(F.col("label") == k).alias(v) for k, v in kinds.items()])


def repository_stats(g: PropertyGraph) -> DataFrame:
    """Files, functions and classes of each repository, counted by containment paths, and distinct modules its files import."""
    from srcgraph.operators.traverse import containment_counts

    counts = containment_counts(g)
    kinds = g.all_nodes(("File", "Function", "Class")).select("id", "label")
    per = counts.join(kinds, "id").groupBy("root").agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n_paths"))), F.lit(0)).alias(v) for k, v in (("File", "files"), ("Function", "functions"), ("Class", "classes"))])
    mods = counts.join(g.edge("IMPORTS").select(F.col("src").alias("id"), "dst"), "id").groupBy("root").agg(F.countDistinct("dst").alias("modules"))
    r = g.node("Repository").select(F.col("id").alias("root"), "name", "path")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.join(per, "root", "left").join(mods, "root", "left").select("name", "path", *[zero(c) for c in ("files", "functions", "classes", "modules")]).orderBy("name")


def contributors(commits: DataFrame) -> DataFrame:
    """Rank of authors (author, email, ts, added, deleted) by commits, then added lines; the latest e-mail."""
    from pyspark.sql import Window

    by = commits.groupBy("author").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max_by("email", "ts").alias("email"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("commits"), F.desc("added"), "author")))


def dominant_type(values: DataFrame, key: str, kind: str) -> DataFrame:
    """The most frequent non-null kind of each key; ties go to the first by name."""
    n = values.where(F.col(kind).isNotNull()).groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(kind)))[kind].alias("dominant"), F.max("n").alias("n"))


def coerced(values: DataFrame, key: str, kind: str, value: str) -> DataFrame:
    """values whose texts have one type for each key, that most of them have: Integer, Float, Boolean or String.

    What can't be read as that type, and null, becomes 0, false or the empty text. Dominant types are few rows a key, and joined by key.
    """
    of = dominant_type(values, key, kind).select(key, "dominant")
    v, k, to = F.col(value), F.col(kind), F.col("dominant")
    number = F.when(k == "Boolean", (F.lower(v) == "true").cast("int").cast("double")).otherwise(F.expr(f"try_cast(`{value}` as double)"))
    true = F.when(k == "Boolean", F.lower(v) == "true").when(k.isin("Integer", "Float"), number != 0).otherwise(v != "")
    out = F.when(to == "Integer", F.coalesce(number, F.lit(0.0)).cast("long").cast("string")).when(to == "Float", F.coalesce(number, F.lit(0.0)).cast("string"))
    out = out.when(to == "Boolean", F.coalesce(true, F.lit(False)).cast("string")).otherwise(F.coalesce(v, F.lit("")))
    return values.join(of, key, "left").withColumn("coerced", out)
