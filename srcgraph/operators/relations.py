"""Who calls, imports, inherits, contains and overrides what. One hop over edges, as joins with total orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import in_repo
from srcgraph.graph import PropertyGraph, shaped

LIMIT = 20
PLACE = ("name", "path", "line_number", "is_dependency")


def _named(df: DataFrame, prefix: str, end: str) -> DataFrame:
    return df.select(F.col("id").alias(end), *[F.col(c).alias(f"{prefix}_{c}") for c in PLACE])


def callers(g: PropertyGraph, name: str, path: str | None = None, repo: str | None = None, n: int | None = LIMIT) -> DataFrame:
    """Calls of the functions of a name. With a path, of the one there by functions, classes and files; if it has none, of all of the name."""
    targets = _named(g.node("Function").where(F.col("name") == name), "callee", "dst")
    sources = ("Function",)
    if path is not None:
        own = targets.where(F.col("callee_path") == path)
        if not g.edge("CALLS").join(own, "dst", "left_semi").isEmpty():
            targets, sources = own, ("Function", "Class", "File")
    by = _named(shaped(g.all_nodes(tuple(s for s in sources if s in g.nodes)), {"id": "string", "name": "string", "path": "string", "line_number": "int", "is_dependency": "boolean"}), "caller", "src")
    found = g.edge("CALLS").join(targets, "dst").join(by.where(in_repo(F.col("caller_path"), repo)), "src")
    found = found.select("caller_name", "caller_path", "caller_line_number", "caller_is_dependency", F.col("line_number").alias("call_line"), F.array_join("args", ",").alias("call_args"), "full_call_name", "callee_name", "callee_path").distinct()
    found = found.orderBy("caller_is_dependency", "caller_path", "caller_line_number", "call_line", "call_args", "full_call_name", "callee_path")
    return found.limit(n) if n else found


def callees(g: PropertyGraph, name: str, path: str | None = None, repo: str | None = None, n: int | None = LIMIT) -> DataFrame:
    """Functions that the functions of a name call."""
    own = g.node("Function").where((F.col("name") == name) & (F.lit(True) if path is None else F.col("path") == path))
    to = _named(g.node("Function").where(in_repo(F.col("path"), repo)), "callee", "dst")
    found = g.edge("CALLS").join(own.select(F.col("id").alias("src")), "src", "left_semi").join(to, "dst")
    found = found.select("callee_name", "callee_path", "callee_line_number", "callee_is_dependency", F.col("line_number").alias("call_line"), F.array_join("args", ",").alias("call_args")).distinct()
    found = found.orderBy("callee_is_dependency", "callee_name", "callee_path", "callee_line_number", "call_line", "call_args")
    return found.limit(n) if n else found


def importers(g: PropertyGraph, module: str, repo: str | None = None, n: int = LIMIT) -> DataFrame:
    """Files that import a module, by name or part of its full name, with all their imports of it in one column."""
    m = g.node("Module").where((F.col("name") == module) | F.col("full_import_name").contains(module)).select(F.col("id").alias("dst"), F.col("name").alias("module"))
    f = g.node("File").where(in_repo(F.col("path"), repo)).select(F.col("id").alias("src"), "path", "is_dependency")
    hits = g.edge("IMPORTS").join(m, "dst").join(f, "src")
    item = F.struct("module", "line_number", "alias")
    found = hits.groupBy("path", "is_dependency").agg(F.count(F.lit(1)).alias("n_imports"), F.array_sort(F.collect_list(item)).alias("items"))
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["module"], x["line_number"].cast("string"), x["alias"])), ";")
    return found.select("path", "is_dependency", "n_imports", shown.alias("imports")).orderBy("is_dependency", "path").limit(n)


def modifiers(g: PropertyGraph, variable: str, repo: str | None = None, n: int = LIMIT) -> DataFrame:
    """What contains the variables of a name: a function, class or file."""
    v = g.node("Variable").where(F.col("name") == variable).select(F.col("id").alias("dst"), F.col("line_number").alias("variable_line"), "value")
    c = g.all_nodes(tuple(x for x in ("Function", "Class", "File") if x in g.nodes)).where(in_repo(F.col("path"), repo)).select(F.col("id").alias("src"), F.lower("label").alias("container_type"), F.col("name").alias("container_name"), "path", "is_dependency")
    return g.pairs("CONTAINS").join(v, "dst").join(c, "src").select("container_type", "container_name", "path", "variable_line", "value", "is_dependency").orderBy("is_dependency", "path", "variable_line").limit(n)


def hierarchy(g: PropertyGraph, cls: str, path: str | None = None, repo: str | None = None) -> DataFrame:
    """Direct parents, direct children and methods of the classes of a name."""
    own = g.node("Class").where((F.col("name") == cls) & (F.lit(True) if path is None else F.col("path") == path)).select("id")
    every = g.node("Class").where(in_repo(F.col("path"), repo)).select("id", *PLACE)
    inherits = g.pairs("INHERITS")

    def side(one: str, other: str, section: str, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        ids = edges.join(own.select(F.col("id").alias(one)), one, "left_semi").select(F.col(other).alias("id")).distinct()
        return nodes.join(ids, "id").select(F.lit(section).alias("section"), *PLACE).distinct()

    methods = g.node("Function").where(in_repo(F.col("path"), repo)).select("id", *PLACE)
    found = side("src", "dst", "parent", inherits, every).unionByName(side("dst", "src", "child", inherits, every)).unionByName(side("src", "dst", "method", g.pairs("CONTAINS"), methods))
    return found.orderBy("section", "is_dependency", "name", "path", "line_number")


def overrides(g: PropertyGraph, function: str, repo: str | None = None, n: int = LIMIT) -> DataFrame:
    """Classes that contain a function of this name."""
    f = g.node("Function").where((F.col("name") == function) & in_repo(F.col("path"), repo)).select(F.col("id").alias("dst"), "name", "path", "line_number", "is_dependency")
    c = g.node("Class").select(F.col("id").alias("src"), F.col("name").alias("class_name"))
    return g.pairs("CONTAINS").join(f, "dst").join(c, "src").select("class_name", "name", "path", "line_number", "is_dependency").orderBy("is_dependency", "class_name", "path", "line_number").limit(n)


def module_importers(g: PropertyGraph, module: str, repo: str | None = None, n: int = 50) -> DataFrame:
    m = g.node("Module").where(F.col("name") == module).select(F.col("id").alias("dst"))
    f = g.node("File").where(in_repo(F.col("path"), repo)).select(F.col("id").alias("src"), "path", "is_dependency")
    return g.edge("IMPORTS").join(m, "dst", "left_semi").join(f, "src").select("path", "line_number", "is_dependency").distinct().orderBy("is_dependency", "path", "line_number").limit(n)


def co_imports(g: PropertyGraph, module: str, n: int = 50) -> DataFrame:
    """Other modules that files importing this one import."""
    m = g.node("Module").where(F.col("name") == module).select(F.col("id").alias("dst"))
    files = g.edge("IMPORTS").join(m, "dst", "left_semi").select("src").distinct()
    others = g.node("Module").where(F.col("name") != module).select(F.col("id").alias("dst"), F.col("name").alias("module"))
    return g.edge("IMPORTS").join(files, "src", "left_semi").join(others, "dst").groupBy("module").agg(F.countDistinct("src").alias("n_files")).orderBy("module").limit(n)


def variable_scope(g: PropertyGraph, variable: str, path: str | None = None, repo: str | None = None) -> DataFrame:
    """Variables of a name with their container, and those nothing contains; path: a whole path or its end."""
    v = g.node("Variable").where((F.col("name") == variable) & in_repo(F.col("path"), repo) & (F.lit(True) if path is None else F.col("path").endswith(path)))
    c = g.all_nodes(tuple(x for x in ("Function", "Class", "File") if x in g.nodes)).select(F.col("id").alias("src"), F.lower("label").alias("scope_type"), F.col("name").alias("scope_name"))
    held = g.pairs("CONTAINS").select("src", F.col("dst").alias("id"))
    inside = v.join(held.join(c, "src"), "id").select("scope_type", "scope_name", "path", "line_number", "value", "is_dependency")
    orphans = v.join(held, "id", "left_anti").select(F.lit("module").alias("scope_type"), F.lit(None).cast("string").alias("scope_name"), "path", "line_number", "value", "is_dependency")
    return inside.unionByName(orphans).orderBy(F.coalesce("is_dependency", F.lit(False)), F.coalesce("path", F.lit("")), F.coalesce("line_number", F.lit(0)))


def caller_files(g: PropertyGraph, path: str) -> DataFrame:
    """Other files with calls into a file."""
    f = g.all_nodes(("Function", "Class")).select("id", "path")
    to = f.where(F.col("path") == path).select(F.col("id").alias("dst"))
    return g.edge("CALLS").join(to, "dst", "left_semi").join(f.where(F.col("path") != path).withColumnRenamed("id", "src"), "src").select("path").distinct()


def inheritance_neighbours(g: PropertyGraph, path: str) -> DataFrame:
    """Files of classes that inherit from a class in a file, or that one there inherits from."""
    c = g.node("Class").select("id", "path")
    e = g.pairs("INHERITS").join(c.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    e = e.where((F.col("a") == path) | (F.col("b") == path))
    return e.select(F.when(F.col("a") == path, F.col("b")).otherwise(F.col("a")).alias("path")).where(F.col("path") != path).distinct()


def class_lookup(g: PropertyGraph, repo: str | None = None) -> DataFrame:
    """The class names of each file."""
    c = g.node("Class").where(in_repo(F.col("path"), repo))
    return c.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))
