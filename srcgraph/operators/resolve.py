"""Names to symbols across files, as joins with priorities, and the graph of a scanned repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.extract import parsed
from srcgraph.functions.text import normalised_decorator, parent
from srcgraph.graph import NODE_COLUMNS, PropertyGraph, node_id, shaped
from srcgraph.operators.traverse import cut, drop

SELF = ("self", "this", "super", "super()", "cls", "@")
#: Builtins whose calls are not linked.
BUILTINS = (
    "print", "len", "range", "int", "str", "float", "bool", "list", "dict", "set", "tuple", "type", "isinstance", "issubclass", "hasattr", "getattr",
    "setattr", "delattr", "super", "property", "classmethod", "staticmethod", "abs", "all", "any", "bin", "chr", "dir", "divmod", "enumerate", "eval",
    "exec", "filter", "format", "frozenset", "globals", "hash", "hex", "id", "input", "iter", "map", "max", "min", "next", "object", "oct", "open",
    "ord", "pow", "repr", "reversed", "round", "slice", "sorted", "sum", "vars", "zip", "callable", "compile", "complex", "breakpoint", "__import__",
    "memoryview", "bytearray", "bytes",
)


def symbol_index(rows: DataFrame) -> DataFrame:
    """(name, path, lang, ord) of every function and class of every file; ord: the place of the file in the order of paths."""
    names = F.transform(F.concat(F.transform("functions", lambda f: f["name"]), F.transform("classes", lambda c: c["name"])), lambda n: n)
    return rows.select(F.explode(F.array_distinct(names)).alias("name"), "path", "lang", F.col("path").alias("ord"))


def local_imports(rows: DataFrame) -> DataFrame:
    """(path, key, full_name): what a file calls a thing it imports, and the thing's full name; the last import of a key wins."""
    e = rows.select("path", F.posexplode("imports").alias("i", "x"))
    key = F.coalesce("x.alias", F.element_at(F.split("x.name", r"\."), -1))
    return e.groupBy("path", key.alias("key")).agg(F.max_by("x.full_import_name", "i").alias("full_name"))


def segment_runs(path: Column) -> Column:
    """All runs of neighbouring segments of a path, without the file's suffix: what an import's path may be found as."""
    parts = F.split(F.regexp_replace(path, r"^/|\.[^./]*$", ""), "/")
    n = F.size(parts)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/")))
    return F.array_distinct(F.flatten(runs))


def import_keys(full_name: Column) -> Column:
    """The paths that an import's thing may be in: 'pkg.mod.f' is looked for as pkg/mod/f and as pkg/mod."""
    slashed = F.replace(full_name, F.lit("."), F.lit("/"))
    module = F.regexp_replace(slashed, r"/[^/]*$", "")
    return F.filter(F.array_distinct(F.array(slashed, module)), lambda k: k != "")


def first_through(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (lang, name, full_name) with `through`, the first path that defines the name and holds the import's path as whole segments.

    An equal join on (lang, name, run of segments): definitions of a common name meet only the imports that name their place.
    """
    wanted = wanted.distinct()
    keys = wanted.select("lang", "name", "full_name", F.explode(import_keys(F.col("full_name"))).alias("run"))
    named = index.join(wanted.select("lang", "name").distinct(), ["lang", "name"], "left_semi")
    places = named.select("lang", "name", "path", F.explode(segment_runs(F.col("path"))).alias("run")).groupBy("lang", "name", "run").agg(F.min("path").alias("path"))
    return keys.join(places, ["lang", "name", "run"]).groupBy("lang", "name", "full_name").agg(F.min("path").alias("through"))


def resolve_calls(rows: DataFrame, skip_external: bool = False, index: DataFrame | None = None) -> DataFrame:
    """A row for each call that is no builtin's: caller, line, called name and the file it is resolved to.

    In turn: self calls stay in the file; names the file defines; the first file with the type that the extractor inferred; names
    only one file of the language defines; imported names by the one file that defines the full name, or the first that the
    import names; the called name where the file itself defines it, or the first file with it that any import of the caller's
    file names; then, flagged `external`, the first file that defines the name, or the caller's own.
    index: (name, path, lang) of the symbols that names are looked up in, the rows' own included; without it those of the rows.
    """
    calls = rows.select("path", "lang", F.explode("function_calls").alias("c")).select("path", "lang", "c.*").where(~F.col("name").isin(*BUILTINS))
    dots = F.length("full_name") - F.length(F.replace(F.col("full_name"), F.lit("."), F.lit("")))
    base = F.when(dots > 0, F.split_part("full_name", F.lit("."), F.lit(1)))
    own = base.isin(*SELF)
    lookup = F.when((dots > 1) & own, F.col("name")).otherwise(F.coalesce(base, "name"))
    mine = F.coalesce(own & (dots <= 1), F.lit(False))
    calls = calls.select("*", mine.alias("mine"), lookup.alias("lookup"))
    # what decides where a call leads is the same for most calls of a file: it is worked out once, and calls are moved once
    what = ["path", "lang", "name", "mine", "lookup", "inferred_obj_type"]
    asked = cut(calls.select(*what).distinct())
    index = symbol_index(rows) if index is None else index
    imports = cut(local_imports(rows).withColumnRenamed("full_name", "full_import"))
    here = index.select("path", F.col("name").alias("lookup"), F.lit(True).alias("local"))
    here_called = index.select("path", "name", F.lit(True).alias("local_called"))
    by = cut(index.groupBy("lang", "name").agg(F.countDistinct("path").alias("files"), F.min("path").alias("first")))
    only = by.select("lang", F.col("name").alias("lookup"), "files", F.col("first").alias("only"))
    typed = by.select("lang", F.col("name").alias("inferred_obj_type"), F.col("first").alias("typed"))
    x = asked.join(here, ["path", "lookup"], "left").join(here_called, ["path", "name"], "left").join(only, ["lang", "lookup"], "left")
    x = x.join(imports.withColumnRenamed("key", "lookup"), ["path", "lookup"], "left").join(typed, ["lang", "inferred_obj_type"], "left")
    x = cut(x.join(by.select("lang", "name", F.col("first").alias("first_called")), ["lang", "name"], "left"))
    # an imported name that several files define: the one its import names, or that defines the full name
    several = x.where((F.col("files") > 1) & F.col("full_import").isNotNull()).select("lang", F.col("lookup").alias("name"), F.col("full_import").alias("full_name"))
    through = first_through(several, index).select("lang", F.col("name").alias("lookup"), F.col("full_name").alias("full_import"), "through")
    direct = by.where("files = 1").select("lang", F.col("name").alias("full_import"), F.col("first").alias("direct"))
    tried = x
    x = x.join(through, ["lang", "lookup", "full_import"], "left").join(direct, ["lang", "full_import"], "left")
    imported = F.coalesce(F.when(F.col("files") > 1, F.col("direct")), "through")
    sure = F.when(F.col("mine"), F.col("path")).when(F.col("local"), F.col("path")).otherwise(F.coalesce("typed", F.when(F.col("files") == 1, F.col("only")), imported, F.when(F.col("local_called"), F.col("path"))))
    x = cut(x.select(*what, "first_called", sure.alias("sure")))
    # what is left, by any import of the caller's file
    open_ = cut(x.where("sure is null and first_called is not null").select("path", "lang", "name").distinct())
    x = x.join(through_any(open_, imports.select("path", F.col("full_import").alias("full_name")).distinct(), index), ["path", "lang", "name"], "left").withColumn("sure", F.coalesce("sure", "rescued"))
    x = x.where("sure is not null") if skip_external else x
    x = cut(x.select(*what, F.coalesce("sure", "first_called", "path").alias("called_path"), F.col("sure").isNull().alias("external")))
    drop(asked, imports, by, tried, open_)
    out = calls.join(x.withColumnRenamed("inferred_obj_type", "_type"), [c for c in what if c != "inferred_obj_type"]).where(F.col("inferred_obj_type").eqNullSafe(F.col("_type")))
    return out.select(
        "path", "lang", F.col("context.name").alias("caller_name"), F.col("context.kind").alias("caller_kind"), F.col("context.line").alias("caller_line"),
        "line_number", "args", F.col("name").alias("called_name"), "called_path", F.col("full_name").alias("full_call_name"), "external",
    )


def through_any(wanted: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (path, lang, name) with `rescued`, the first path that defines the name and that any import (path, full_name) of the file names.

    A file either meets all names of the places that it imports, or asks for each of its names in each of them: the fewer rows of the two.
    """
    runs = wanted.select("path", "lang").distinct().join(imports, "path").select("path", "lang", F.explode(import_keys(F.col("full_name"))).alias("run")).distinct()
    named = index.join(wanted.select("lang", "name").distinct(), ["lang", "name"], "left_semi")
    places = named.select("lang", "name", "path", F.explode(segment_runs(F.col("path"))).alias("run")).join(runs.select("lang", "run").distinct(), ["lang", "run"], "left_semi")
    places = cut(places.groupBy("lang", "run", "name").agg(F.min("path").alias("at")))
    runs = cut(runs.join(places.groupBy("lang", "run").agg(F.count(F.lit(1)).alias("held")), ["lang", "run"]))
    cost = runs.groupBy("path", "lang").agg(F.sum("held").alias("met"), F.count(F.lit(1)).alias("n")).join(wanted.groupBy("path", "lang").agg(F.count(F.lit(1)).alias("names")), ["path", "lang"])
    few = cut(cost.where("met <= n * names").select("path", "lang"))
    met = runs.join(few, ["path", "lang"], "left_semi").join(places, ["lang", "run"]).groupBy("path", "lang", "name").agg(F.min("at").alias("rescued"))
    met = wanted.join(met, ["path", "lang", "name"])
    asked = wanted.join(few, ["path", "lang"], "left_anti").join(runs.drop("held"), ["path", "lang"])
    asked = asked.join(places, ["lang", "run", "name"]).groupBy("path", "lang", "name").agg(F.min("at").alias("rescued"))
    return met.unionByName(asked)


def resolve_inheritance(rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(path, child, parent, parent_path) of classes and their bases.

    A simple base: a class of the file, else what its import names, else, if nothing is imported so, the only file that defines
    it. A dotted base: what the import of its first part names. An import that names no file with such a class links nothing.
    classes: (name, path, lang) of the classes that names are looked up in, the rows' own included; without it those of the rows.
    """
    e = rows.select("path", "lang", F.explode("classes").alias("c")).select("path", "lang", F.col("c.name").alias("child"), F.explode("c.bases").alias("base")).where("base <> 'object'").distinct()
    e = e.withColumn("parent", F.element_at(F.split("base", r"\."), -1)).withColumn("key", F.split_part("base", F.lit("."), F.lit(1)))
    if classes is None:
        classes = rows.select("path", "lang", F.explode(F.transform("classes", lambda c: c["name"])).alias("name")).distinct()
    only = classes.groupBy("lang", F.col("name").alias("parent")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("only"))
    e = e.join(classes.select("path", F.col("name").alias("parent"), F.lit(True).alias("local")), ["path", "parent"], "left").join(local_imports(rows), ["path", "key"], "left").join(only, ["lang", "parent"], "left")
    through = first_through(e.where("full_name is not null").select("lang", F.col("parent").alias("name"), "full_name"), classes).withColumnRenamed("name", "parent")
    e = e.join(through, ["lang", "parent", "full_name"], "left")
    dotted = F.contains(F.col("base"), F.lit("."))
    simple = F.when(F.col("local"), F.col("path")).when(F.col("full_name").isNotNull(), F.col("through")).when(F.col("files") == 1, F.col("only"))
    return e.select("path", "child", "parent", F.when(dotted, F.col("through")).otherwise(simple).alias("parent_path")).where("parent_path is not null").distinct()


def folders(files: DataFrame, root: str) -> DataFrame:
    """(path, name, up) of the folders between root and files."""
    n = F.size(F.split("relative_path", "/")) - 1
    prefix = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(root + "/"), F.array_join(F.slice(F.split("relative_path", "/"), F.lit(1), i), "/")))
    return files.where(n > 0).select(F.explode(prefix).alias("path")).distinct().select("path", F.element_at(F.split("path", "/"), -1).alias("name"), parent(F.col("path")).alias("up"))


SEP = "\u0001"
#: Labels of symbols that calls may lead to, beside functions, and of those that functions may be in.
TYPES, HOLDERS = ("Class", "Struct", "Enum"), ("Class", "Struct", "Enum", "Trait")


def _file_id() -> Column:
    return F.concat_ws(SEP, F.lit("File"), "path")


def _united(g: PropertyGraph, labels: tuple[str, ...], *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [shaped(g.node(x), NODE_COLUMNS).select(*columns) for x in labels])


def symbol_graph(rows: DataFrame, root: str, name: str | None = None, is_dependency: bool = False) -> PropertyGraph:
    """What parse rows hold of themselves: the repository, its folders, files and symbols, and what contains, takes, imports and decorates what."""
    spark, dep = rows.sparkSession, F.lit(is_dependency)
    nodes, edges = {}, {}
    repo = spark.createDataFrame([(root, name or root.rsplit("/", 1)[-1], is_dependency)], "path string, name string, is_dependency boolean")
    nodes["Repository"] = repo.withColumn("id", node_id("Repository"))
    dirs = folders(rows, root)
    nodes["Directory"] = dirs.select("path", "name").withColumn("id", node_id("Directory"))
    file_name = F.element_at(F.split("path", "/"), -1)
    nodes["File"] = rows.select("path", file_name.alias("name"), "relative_path", "lang", dep.alias("is_dependency"), "error").withColumn("id", node_id("File"))

    def folder(up: Column) -> Column:
        return F.when(up == root, F.concat_ws(SEP, F.lit("Repository"), up)).otherwise(F.concat_ws(SEP, F.lit("Directory"), up))

    contains = [
        dirs.select(folder(F.col("up")).alias("src"), F.concat_ws(SEP, F.lit("Directory"), "path").alias("dst")),
        rows.select(folder(parent(F.col("path"))).alias("src"), _file_id().alias("dst")),
    ]

    def symbols(label: str, column: str, kind: str | None = None) -> DataFrame:
        x = rows.select("path", "lang", dep.alias("is_dependency"), F.explode(column).alias("s")).select("path", "lang", "is_dependency", "s.*")
        x = x.where(F.col("kind") == kind) if kind else x
        x = x.withColumn("id", node_id(label)).dropDuplicates(["id"])
        nodes[label] = x
        contains.append(x.select(_file_id().alias("src"), F.col("id").alias("dst")))
        return x

    f = symbols("Function", "functions")
    for label in HOLDERS:
        symbols(label, "classes", label.lower())
    symbols("Variable", "variables")
    holders = _united(PropertyGraph(spark, nodes), HOLDERS, "id", "name", "path")
    in_class = holders.select(F.col("id").alias("src"), F.col("name").alias("class_context"), "path")
    contains.append(f.join(in_class, ["class_context", "path"]).select("src", F.col("id").alias("dst")))
    outer = f.select(F.col("id").alias("src"), F.col("name").alias("context"), "path")
    contains.append(f.where("context_type = 'function_definition'").join(outer, ["context", "path"]).select("src", F.col("id").alias("dst")))
    edges["CONTAINS"] = reduce(DataFrame.unionByName, contains).distinct()
    p = f.select(F.col("id").alias("src"), "path", F.col("line_number").alias("function_line_number"), F.explode(F.array_distinct("args")).alias("name"))
    p = p.withColumn("dst", node_id("Parameter"))
    nodes["Parameter"] = p.select(F.col("dst").alias("id"), "name", "path", "function_line_number").dropDuplicates(["id"])
    edges["HAS_PARAMETER"] = p.select("src", "dst").distinct()
    i = rows.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    nodes["Module"] = i.groupBy("name").agg(F.max_by("alias", "path").alias("alias"), F.min("full_import_name").alias("full_import_name")).withColumn("id", node_id("Module"))
    i = i.groupBy("path", "name").agg(F.max("line_number").alias("line_number"), F.max_by("alias", "line_number").alias("alias"))
    edges["IMPORTS"] = i.select(_file_id().alias("src"), F.concat_ws(SEP, F.lit("Module"), "name").alias("dst"), "line_number", "alias", F.col("name").alias("imported_name"))
    d = f.select("id", "line_number", F.explode("decorators").alias("raw")).unionByName(nodes["Class"].select("id", "line_number", F.explode("decorators").alias("raw")))
    d = d.withColumn("name", normalised_decorator(F.col("raw")))
    nodes["Decorator"] = d.select("name").distinct().withColumn("id", node_id("Decorator"))
    edges["DECORATED_BY"] = d.select(F.col("id").alias("src"), F.concat_ws(SEP, F.lit("Decorator"), "name").alias("dst"), "line_number", "raw").dropDuplicates(["src", "dst"])
    return PropertyGraph(spark, nodes, edges)


def linked(rows: DataFrame, g: PropertyGraph, skip_external: bool = False) -> PropertyGraph:
    """The edges across files that start in parse rows: CALLS, INHERITS and IMPLEMENTS, with both ends among the symbols of a graph, which the names are looked up in."""
    index = _united(g, ("Function", *HOLDERS), "name", "path", "lang").distinct()
    classes = _united(g, HOLDERS, "name", "path", "lang").distinct()
    types, c = _united(g, TYPES, "id", "name", "path"), g.node("Class").select("id", "name", "path")
    edges = {}
    m = rows.select("path", F.explode("impls").alias("m")).select("path", "m.*")
    traits = g.node("Trait").select(F.col("id").alias("dst"), F.col("name").alias("trait_name"))
    edges["IMPLEMENTS"] = m.join(types.select(F.col("id").alias("src"), F.col("name").alias("type_name"), "path"), ["type_name", "path"]).join(traits, "trait_name").select("src", "dst", "line_number").distinct()
    h = resolve_inheritance(rows, classes)
    h = h.join(c.select(F.col("id").alias("src"), F.col("name").alias("child"), "path"), ["child", "path"])
    edges["INHERITS"] = h.join(c.select(F.col("id").alias("dst"), F.col("name").alias("parent"), F.col("path").alias("parent_path")), ["parent", "parent_path"]).select("src", "dst").distinct()
    f = g.node("Function").select("id", "name", "path", "line_number")
    to = f.select("id", "name", "path").unionByName(types).select(F.col("id").alias("dst"), F.col("name").alias("called_name"), F.col("path").alias("called_path"))
    calls = resolve_calls(rows, skip_external, index).join(to, ["called_name", "called_path"])
    callers = f.unionByName(g.node("Class").select("id", "name", "path", "line_number"))
    callers = callers.select(F.col("id").alias("caller"), F.col("name").alias("caller_name"), "path", F.col("line_number").alias("caller_line"))
    calls = calls.join(callers, ["caller_name", "path", "caller_line"], "left").withColumn("src", F.coalesce("caller", _file_id()))
    edges["CALLS"] = calls.select("src", "dst", "line_number", "args", "full_call_name").dropDuplicates(["src", "dst", "line_number", "args", "full_call_name"])
    return PropertyGraph(g.spark, {}, edges)


def index_repository(files: DataFrame, root: str, name: str | None = None, is_dependency: bool = False, skip_external: bool = False, sources: bool = True) -> PropertyGraph:
    """The graph of files (path, relative_path, text) of a repository at root. Files that can't be parsed stay as files, with their error.

    sources: whether symbols keep their source and docstring.
    """
    root = root.rstrip("/")
    rows = cut(parsed(files, sources))
    g = symbol_graph(rows, root, name, is_dependency)
    return PropertyGraph(g.spark, g.nodes, g.edges | linked(rows, g, skip_external).edges)


def call_groups(g: PropertyGraph) -> DataFrame:
    """How many calls there are from each kind of caller to each kind of callee."""
    kinds = g.all_nodes(tuple(x for x in ("Function", "Class", "File", "Struct", "Enum") if x in g.nodes)).select("id", "label")
    e = g.edge("CALLS").join(kinds.select(F.col("id").alias("src"), F.col("label").alias("caller_label")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("label").alias("callee_label")), "dst")
    return e.groupBy("caller_label", "callee_label").agg(F.count(F.lit(1)).alias("n"))


def first_by(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
