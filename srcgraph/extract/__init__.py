"""Source text to rows of symbols. An extractor is a function from text to a dict of lists, registered by language."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

EXTRACTORS: dict[str, Callable[[str], dict]] = {}
#: Indexed suffixes and their language.
LANGUAGES = {".py": "python", ".ipynb": "python", ".rs": "rust"}
CONTEXT = "name string, kind string, line int"
#: The fields of a parse row.
ROW = f"""error string,
functions array<struct<name string, line_number int, end_line int, args array<string>, cyclomatic_complexity int, context string, context_type string, class_context string, decorators array<string>, is_async boolean, source string, docstring string>>,
classes array<struct<name string, line_number int, end_line int, bases array<string>, context string, decorators array<string>, kind string, source string, docstring string>>,
variables array<struct<name string, line_number int, value string, type string, context string, class_context string>>,
imports array<struct<name string, full_import_name string, line_number int, alias string>>,
function_calls array<struct<name string, full_name string, line_number int, args array<string>, inferred_obj_type string, context struct<{CONTEXT}>, class_context string, is_indirect_call boolean>>,
impls array<struct<type_name string, trait_name string, line_number int>>"""
KINDS = ("functions", "classes", "variables", "imports", "function_calls", "impls")


def extractor(lang: str):
    def register(f):
        EXTRACTORS[lang] = f
        return f

    return register


def notebook_source(text: str) -> str:
    """The code cells of a notebook, one after another."""
    cells = json.loads(text).get("cells", [])
    return "\n\n".join("".join(c["source"]) if isinstance(c["source"], list) else c["source"] for c in cells if c.get("cell_type") == "code") + "\n"


def extract(path: str, text: str) -> dict:
    """The row of a file; whatever goes wrong is its error and leaves its lists empty."""
    from srcgraph.extract import python, rust  # noqa: F401

    empty = {k: [] for k in KINDS} | {"error": None}
    try:
        suffix = "." + path.rsplit(".", 1)[-1]
        return empty | EXTRACTORS[LANGUAGES[suffix]](notebook_source(text) if suffix == ".ipynb" else text)
    except Exception as e:
        return empty | {"error": f"{type(e).__name__}: {e}"[:500]}


def parsed(files: DataFrame, sources: bool = True) -> DataFrame:
    """files (path, text) with their language and what extract() finds, in one pass over the texts; without sources, symbols have neither source nor docstring."""
    carried = [c for c in files.columns if c != "text"]
    row = files.sparkSession.createDataFrame([], ROW).schema
    schema = T.StructType([*files.select(*carried).schema.fields, *row.fields])
    arrow = to_arrow_schema(row)

    def look(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [extract(p, t or "") for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist())]
            for r in [] if sources else rows:
                for symbol in (*r["functions"], *r["classes"]):
                    symbol["source"] = symbol["docstring"] = None
            found = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *found], names=[*carried, *arrow.names])

    lang = F.coalesce(*[F.when(F.col("path").endswith(s), v) for s, v in LANGUAGES.items()])
    return files.mapInArrow(look, schema).withColumn("lang", lang)
