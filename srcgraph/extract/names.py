"""Names only, for languages without an extractor of their own: definitions, imports, calls and bases by patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from srcgraph.graph import PropertyGraph, node_id

NAME = r"([A-Za-z_$][\w$]*)"
MODULE = r"""['"<]([^'"<>\n]+)['">]"""


@dataclass(frozen=True)
class Language:
    """Patterns whose first group is a name; bases: a list of names after a class's own."""

    suffixes: tuple[str, ...]
    functions: tuple[str, ...]
    classes: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    bases: tuple[str, ...] = ()
    comments: tuple[str, ...] = field(default=(r"//[^\n]*", r"(?s)/\*.*?\*/"))


_C_BODY = r"\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*)?\{"
_JS = (rf"\bfunction\s*\*?\s*{NAME}\s*\(", rf"\b(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|{NAME}\s*=>)", rf"(?m)(?:^|[{{}};])\s*(?:async\s+|static\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|function|return)\b){NAME}\s*\([^()]*\)\s*\{{")
_JS_IMPORTS = (rf"\bfrom\s*{MODULE}", rf"\bimport\s*{MODULE}", rf"\brequire\s*\(\s*{MODULE}")
LANGUAGES = {
    "javascript": Language((".js", ".jsx", ".mjs", ".cjs"), _JS, (rf"\bclass\s+{NAME}",), _JS_IMPORTS, (rf"\bclass\s+{NAME}\s+extends\s+([\w$.]+)",)),
    "typescript": Language((".ts", ".tsx"), _JS, (rf"\b(?:class|interface)\s+{NAME}",), _JS_IMPORTS, (rf"\bclass\s+{NAME}(?:<[^>]*>)?\s+extends\s+([\w$.]+)",)),
    "java": Language((".java",), (rf"\b[\w<>\[\],.]+\s+(?!(?:new|return|else|if|for|while|switch)\b){NAME}\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w.,\s]+)?\{{",), (rf"\b(?:class|interface|enum|record)\s+{NAME}",), (r"\bimport\s+(?:static\s+)?([\w.]+)",), (rf"\bclass\s+{NAME}(?:<[^>]*>)?\s+extends\s+([\w.]+)",)),
    "c": Language((".c", ".h"), (rf"(?m)^[A-Za-z_][\w\s*]*?\b(?!(?:if|for|while|switch|else|return)\b){NAME}\s*{_C_BODY}",), (rf"\b(?:struct|enum|union)\s+{NAME}\s*\{{",), (rf"#\s*include\s*{MODULE}",)),
    "cpp": Language((".cpp", ".cc", ".cxx", ".hpp", ".hh"), (rf"(?m)^[A-Za-z_][\w\s*&:<>,~]*?\b(?!(?:if|for|while|switch|else|return|catch)\b){NAME}\s*{_C_BODY}",), (rf"\b(?:class|struct|enum)\s+{NAME}\s*[:{{]",), (rf"#\s*include\s*{MODULE}",), (rf"\b(?:class|struct)\s+{NAME}\s*:\s*(?:public|private|protected|virtual|\s)*([\w:]+)",)),
    "go": Language((".go",), (rf"\bfunc\s+(?:\([^()]*\)\s*)?{NAME}\s*[\[(]",), (rf"\btype\s+{NAME}\s+(?:struct|interface)",), (r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$""",)),
    "ruby": Language((".rb",), (r"\bdef\s+(?:self\.)?([A-Za-z_]\w*[?!]?)",), (r"\b(?:class|module)\s+([A-Z]\w*)",), (rf"\brequire(?:_relative)?\s*\(?\s*{MODULE}",), (r"\bclass\s+([A-Z]\w*)\s*<\s*([\w:]+)",), (r"#[^\n]*",)),
    "php": Language((".php",), (rf"\bfunction\s+&?\s*{NAME}\s*\(",), (rf"\b(?:class|interface|trait)\s+{NAME}",), (r"(?m)^\s*use\s+([\w\\]+)", rf"\b(?:require|include)(?:_once)?\s*\(?\s*{MODULE}"), (rf"\bclass\s+{NAME}\s+extends\s+([\w\\]+)",), (r"//[^\n]*", r"(?s)/\*.*?\*/", r"#[^\n]*")),
    "kotlin": Language((".kt", ".kts"), (rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{NAME}\s*\(",), (rf"\b(?:class|interface|object)\s+{NAME}",), (r"(?m)^\s*import\s+([\w.]+)",), (rf"\bclass\s+{NAME}(?:\([^()]*\))?\s*:\s*([\w.]+)",)),
    "dart": Language((".dart",), (rf"\b[\w<>?]+\s+(?!(?:if|for|while|switch|return|new|else)\b){NAME}\s*\([^;{{}}()]*\)\s*(?:async\s*)?(?:\{{|=>)",), (rf"\b(?:class|mixin|enum)\s+{NAME}",), (rf"\bimport\s+{MODULE}",), (rf"\bclass\s+{NAME}\s+extends\s+([\w.]+)",)),
    "csharp": Language((".cs",), (rf"\b[\w<>\[\],.?]+\s+(?!(?:new|return|else|if|for|while|switch|using|lock|catch)\b){NAME}\s*\([^;{{}}()]*\)\s*(?:\{{|=>)",), (rf"\b(?:class|interface|struct|enum|record)\s+{NAME}",), (r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;",), (rf"\bclass\s+{NAME}(?:<[^>]*>)?\s*:\s*([\w.]+)",)),
    "swift": Language((".swift",), (rf"\bfunc\s+{NAME}\s*[<(]",), (rf"\b(?:class|struct|enum|protocol|actor)\s+{NAME}",), (r"(?m)^\s*import\s+([\w.]+)",), (rf"\bclass\s+{NAME}\s*:\s*([\w.]+)",)),
    "perl": Language((".pl", ".pm"), (rf"\bsub\s+{NAME}",), (r"\bpackage\s+([\w:]+)",), (r"(?m)^\s*(?:use|require)\s+([A-Z][\w:]*)",), (), (r"#[^\n]*",)),
}
#: Words before a bracket that call nothing.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "sizeof", "def", "fun", "func", "sub", "elsif", "unless", "until", "foreach", "match", "when", "super", "typeof", "new")


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for lang, known in LANGUAGES.items():
        for s in known.suffixes:
            out = F.when(path.endswith(s), lang).otherwise(out)
    return out


def bare(text: str, lang: str) -> str:
    """A text without comments."""
    for pattern in LANGUAGES[lang].comments:
        text = re.sub(pattern, " ", text)
    return text


def _all(text: str, patterns: tuple[str, ...]) -> list[str]:
    """The first groups that matched, once each, in order of place within a pattern."""
    found = (next((g for g in m.groups() if g), "") for p in patterns for m in re.finditer(p, text))
    return [*dict.fromkeys(x for x in found if x)]


def names_of(lang: str, text: str) -> dict[str, list]:
    known, text = LANGUAGES[lang], bare(text, lang)
    classes = [x for x in _all(text, known.classes) if len(x) > 1]
    functions = [x for x in _all(text, known.functions) if len(x) > 1 and x not in classes]
    calls = [x for x in _all(text, (rf"\b{NAME}\s*\(",)) if len(x) > 1 and x not in NO_CALLS]
    bases = [{"child": m[1], "parent": m[2]} for p in known.bases for m in re.finditer(p, text)]
    return {"functions": functions, "classes": classes, "imports": _all(text, known.imports), "calls": calls, "bases": bases}


ROW = "path string, lang string, functions array<string>, classes array<string>, imports array<string>, calls array<string>, bases array<struct<child: string, parent: string>>"


def names(files: DataFrame) -> DataFrame:
    """A row for each file (path, text) of a known language: path, lang, functions, classes, imports, calls, and bases as (child, parent).

    Names of one letter are left out, as are words of the language before a bracket. Null texts count as empty; files of other
    languages give no row. One pass over the texts.
    """
    known = files.select("path", "text").withColumn("lang", language_of(F.col("path"))).where("lang is not null")
    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], ROW).schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, "lang": lang} | names_of(lang, t or "") for p, t, lang in zip(*(b.column(c).to_pylist() for c in ("path", "text", "lang")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], names=arrow.names)

    return known.mapInArrow(look, ROW)


def resolve_loosely(calls: DataFrame, symbols: DataFrame, labels: tuple[str | None, ...] = ("Function", "Class", None)) -> DataFrame:
    """calls (caller, name, path) with the symbol (id, label, name, path, ord) that each name stands for: (caller, target).

    By label in turn, last by any: the only one of the name, else the first of the caller's file, else the first. None leads to itself.
    """
    found = calls.select("caller", "name", "path").distinct()
    first = F.min(F.struct("ord", "id"))["id"]
    choice = []
    for i, label in enumerate(labels):
        own = symbols if label is None else symbols.where(F.col("label") == label)
        any_ = own.groupBy("name").agg(F.count(F.lit(1)).alias(f"n{i}"), first.alias(f"any{i}"))
        here = own.groupBy("name", "path").agg(first.alias(f"here{i}"))
        found = found.join(any_, "name", "left").join(here, ["name", "path"], "left")
        choice.append(F.when(F.col(f"n{i}") == 1, F.col(f"any{i}")).otherwise(F.coalesce(f"here{i}", f"any{i}")))
    out = found.select("caller", F.coalesce(*choice).alias("target")).where("target is not null and target <> caller")
    return out.distinct()


def names_graph(files: DataFrame) -> PropertyGraph:
    """The graph of names: files, functions, classes and modules; what contains, imports, calls and inherits what. Files call, as what a call stands in is not known."""
    from srcgraph.operators.traverse import cut

    rows = cut(names(files))
    nodes, edges = {}, {}
    nodes["File"] = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "lang").withColumn("id", node_id("File"))
    file_id = F.concat_ws("\u0001", F.lit("File"), "path")
    contains = None
    for label, column in (("Function", "functions"), ("Class", "classes")):
        x = rows.select("path", "lang", F.posexplode(column).alias("ord", "name")).withColumn("line_number", F.lit(None).cast("int")).withColumn("id", node_id(label))
        nodes[label] = x.drop("ord")
        e = x.select(F.concat_ws("\u0001", F.lit("File"), "path").alias("src"), F.col("id").alias("dst"))
        contains = e if contains is None else contains.unionByName(e)
    edges["CONTAINS"] = contains
    i = rows.select("path", F.explode("imports").alias("name"))
    nodes["Module"] = i.select("name", F.col("name").alias("full_import_name")).distinct().withColumn("id", node_id("Module"))
    edges["IMPORTS"] = i.select(file_id.alias("src"), F.concat_ws("\u0001", F.lit("Module"), "name").alias("dst"), F.col("name").alias("imported_name"))
    symbols = nodes["Function"].select("id", F.lit("Function").alias("label"), "name", "path").unionByName(nodes["Class"].select("id", F.lit("Class").alias("label"), "name", "path")).withColumn("ord", F.concat_ws(":", "path", "id"))
    calls = rows.select(file_id.alias("caller"), "path", F.explode("calls").alias("name"))
    edges["CALLS"] = resolve_loosely(calls, symbols).select(F.col("caller").alias("src"), F.col("target").alias("dst"), F.lit(None).cast("int").alias("line_number"))
    h = rows.select("path", F.explode("bases").alias("b")).select("path", F.col("b.child").alias("child"), F.regexp_extract("b.parent", r"(\w+)$", 1).alias("name"))
    h = h.join(nodes["Class"].select("path", F.col("name").alias("child"), F.col("id").alias("caller")), ["path", "child"])
    edges["INHERITS"] = resolve_loosely(h, symbols, ("Class", None)).select(F.col("caller").alias("src"), F.col("target").alias("dst"))
    return PropertyGraph(files.sparkSession, nodes, edges)
