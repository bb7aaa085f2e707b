"""Finding symbols by name, text, argument, decorator, trait and type. Results have a total order, so limits are stable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import in_repo, normalised_decorator
from srcgraph.graph import PropertyGraph, shaped

PLACE = {"id": "string", "name": "string", "path": "string", "line_number": "int", "is_dependency": "boolean"}
LIMIT = 20


def _places(g: PropertyGraph, label: str, more: dict[str, str] | None = None) -> DataFrame:
    return shaped(g.node(label), PLACE | (more or {}))


def _top(df: DataFrame, *order, n: int | None = LIMIT) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(n) if n else df


def by_name(g: PropertyGraph, label: str, name: str, repo: str | None = None) -> DataFrame:
    """Symbols of a label with exactly this name."""
    return _top(_places(g, label).where((F.col("name") == name) & in_repo(F.col("path"), repo)), "path", "line_number", "id")


def by_similar_name(g: PropertyGraph, label: str, name: str, edits: int = 2, repo: str | None = None) -> DataFrame:
    """Names within an edit distance, letter case aside, nearest first. Lengths rule most names out before distances are taken; all candidates count."""
    own = F.lower("name")
    near = _places(g, label).where((F.abs(F.length("name") - len(name)) <= edits) & in_repo(F.col("path"), repo))
    near = near.withColumn("distance", F.levenshtein(own, F.lit(name.lower()), edits)).where("distance >= 0")
    return _top(near, "distance", "name", "path", "line_number", "id")


def variables(g: PropertyGraph, part: str, repo: str | None = None) -> DataFrame:
    return _top(_places(g, "Variable").where(F.col("name").contains(part) & in_repo(F.col("path"), repo)), "is_dependency", "name", "path", "line_number", "id")


def by_content(g: PropertyGraph, part: str, repo: str | None = None) -> DataFrame:
    """Functions, then classes, whose name, source or docstring contains the text, letter case aside."""
    found = []
    for i, label in enumerate(("Function", "Class")):
        df = _places(g, label, {"source": "string", "docstring": "string"})
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(part.lower()), F.lit(False)) for c in ("name", "source", "docstring")])
        df = _top(df.where(hit & in_repo(F.col("path"), repo)), "is_dependency", "path", "line_number", "id")
        found.append(df.select("*", F.lit(label.lower()).alias("type"), F.lit(i).alias("place")))
    return _top(found[0].unionByName(found[1]), "place", "is_dependency", "path", "line_number", "id").drop("place", "source", "docstring")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def full_text(g: PropertyGraph, query: str, edits: int = 0, repo: str | None = None, n: int = LIMIT) -> DataFrame:
    """Functions, classes and variables by the query's words in name (3 points), docstring (2) and source (1), each word within `edits`.

    score: points of the best field of each word, summed; the rank stands in for a text index's, only membership is meant to agree.
    """
    wanted = [w for w in query.lower().replace("_", " ").split() if w]
    every = g.all_nodes(("Function", "Class", "Variable")).where(in_repo(F.col("path"), repo))

    def points(word: str) -> Column:
        out = []
        for c, p in (("name", 3), ("docstring", 2), ("source", 1)):
            same = (lambda t: F.levenshtein(t, F.lit(word), edits) >= 0) if edits else (lambda t: t == word)
            out.append(F.when(F.exists(tokens(F.regexp_replace(F.col(c), "_", " ")), same), p).otherwise(0))
        return F.greatest(*out)

    score = reduce(lambda a, b: a + b, [points(w) for w in wanted], F.lit(0))
    found = every.select("id", "label", "name", "path", "line_number", "is_dependency", score.alias("score")).where("score > 0")
    return _top(found, F.desc("score"), "is_dependency", "path", "line_number", "id", n=n)


def modules(g: PropertyGraph, part: str) -> DataFrame:
    return _top(g.node("Module").select("name", "full_import_name").where(F.col("name").contains(part)), "name")


def imports_of(g: PropertyGraph, name: str) -> DataFrame:
    """Imports under this alias or of this name."""
    e = g.edge("IMPORTS").where((F.col("alias") == name) | (F.col("imported_name") == name))
    f = g.node("File").select(F.col("id").alias("src"), "path", "is_dependency")
    m = g.node("Module").select(F.col("id").alias("dst"), F.col("name").alias("module"))
    return _top(e.join(f, "src").join(m, "dst").select("path", "module", "alias", "imported_name", "line_number", "is_dependency"), "path", "module", "line_number")


RELEVANCE = {"function": (0.9, 0.7), "class": (0.8, 0.6), "variable": (0.7, 0.5), "content": (0.6, 0.4)}


def related(g: PropertyGraph, query: str, fuzzy: bool = False, edits: int = 2, repo: str | None = None, n: int = 15) -> DataFrame:
    """The searches together, ranked by kind of hit and by whether it is the project's own; total: how many hits there are."""
    name = (lambda label: by_similar_name(g, label, query, edits, repo).drop("distance")) if fuzzy else (lambda label: by_name(g, label, query, repo))
    hits = {"function": name("Function"), "class": name("Class"), "variable": variables(g, query, repo), "content": by_content(g, query, repo).drop("type")}
    every = []
    for i, (kind, df) in enumerate(hits.items()):
        own, other = RELEVANCE[kind]
        every.append(df.select(*PLACE, F.lit(kind).alias("search_type"), F.when(F.col("is_dependency"), other).otherwise(own).alias("relevance"), F.lit(i).alias("turn")))
    all_ = reduce(DataFrame.unionByName, every)
    counted = all_.crossJoin(F.broadcast(all_.agg(F.count(F.lit(1)).alias("total"))))  # one row
    return _top(counted, F.desc("relevance"), "turn", "path", "line_number", "id", n=n).drop("turn")


def by_argument(g: PropertyGraph, arg: str, path: str | None = None, repo: str | None = None) -> DataFrame:
    p = g.node("Parameter").where(F.col("name") == arg).select(F.col("id").alias("dst"))
    f = _places(g, "Function").where(in_repo(F.col("path"), repo) & (F.lit(True) if path is None else F.col("path") == path))
    hits = g.pairs("HAS_PARAMETER").join(p, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return _top(f.join(hits, "id"), "is_dependency", "path", "line_number", "id")


def by_decorator(g: PropertyGraph, decorator: str, path: str | None = None, repo: str | None = None) -> DataFrame:
    """Functions and classes with a decorator, given raw or bare."""
    bare = normalised_decorator(F.lit(decorator))
    d = g.node("Decorator").where(F.col("name") == bare).select(F.col("id").alias("dst"))
    hits = g.edge("DECORATED_BY").join(d, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    f = g.all_nodes(("Function", "Class")).where(in_repo(F.col("path"), repo) & (F.lit(True) if path is None else F.col("path") == path))
    return _top(f.join(hits, "id").select("label", *PLACE), "is_dependency", "path", "line_number", "id")


def implementors(g: PropertyGraph, trait: str, repo: str | None = None, n: int = 50) -> DataFrame:
    t = g.node("Trait").where(F.col("name") == trait).select(F.col("id").alias("dst"))
    e = g.edge("IMPLEMENTS").join(t, "dst", "left_semi").select(F.col("src").alias("id"), F.col("line_number").alias("impl_line"))
    f = g.all_nodes(tuple(x for x in ("Class", "Struct", "Enum") if x in g.nodes)).where(in_repo(F.col("path"), repo))
    return _top(f.join(e, "id").select("label", "id", "name", "path", "impl_line", "is_dependency"), "path", "impl_line", "id", n=n)


def by_type(g: PropertyGraph, kind: str, n: int = 50) -> DataFrame:
    """All of a kind: function, class, file or module; no rows for other kinds."""
    kind = kind.lower()
    if kind == "module":
        return _top(g.node("Module").select("name", F.col("name").alias("path"), F.lit(False).alias("is_dependency")), "name", n=n)
    if kind == "file":
        return _top(g.node("File").select("name", "path", "is_dependency"), "path", n=n)
    label = {"function": "Function", "class": "Class"}.get(kind)
    found = _places(g, label or "Function").where(F.lit(label is not None))
    return _top(found.select("name", "path", "line_number", "is_dependency"), "is_dependency", "name", "path", "line_number", n=n)


def everything_named(g: PropertyGraph, name: str) -> DataFrame:
    """Functions, classes, files, variables, modules and imports by name, with their kind."""
    own = [by_name(g, "Function", name).select("name", "path", "line_number", F.lit("function").alias("type")), by_name(g, "Class", name).select("name", "path", "line_number", F.lit("class").alias("type"))]
    own.append(g.node("File").where(F.col("name") == name).select("name", "path", F.lit(None).cast("int").alias("line_number"), F.lit("file").alias("type")))
    own.append(variables(g, name).select("name", "path", "line_number", F.lit("variable").alias("type")))
    own.append(modules(g, name).select("name", F.col("name").alias("path"), F.lit(None).cast("int").alias("line_number"), F.lit("module").alias("type")))
    own.append(imports_of(g, name).select(F.col("module").alias("name"), "path", "line_number", F.lit("import").alias("type")))
    return reduce(DataFrame.unionByName, own)


def by_pattern(g: PropertyGraph, part: str, case_sensitive: bool = False, n: int = 50) -> DataFrame:
    df = g.all_nodes(("Function", "Class", "Module", "Variable"))
    hit = F.col("name").contains(part) if case_sensitive else F.lower("name").contains(part.lower())
    return _top(df.where(hit).select("label", "name", "path", "line_number", F.coalesce("is_dependency", F.lit(False)).alias("is_dependency")), "is_dependency", "name", "label", F.asc_nulls_last("path"), "line_number", n=n)
