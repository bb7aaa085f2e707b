"""A labelled property graph as node and edge DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels, edge types and keys of the graph.
SYMBOLS = ("Function", "Class", "Struct", "Enum", "Trait", "Interface", "Variable")
NODE_LABELS = ("Repository", "Directory", "File", *SYMBOLS, "Module", "Parameter", "Decorator", "Macro", "Union", "Record", "Property", "Annotation")
EDGE_TYPES = ("CONTAINS", "CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "HAS_PARAMETER", "DECORATED_BY", "INCLUDES")
#: Columns that identify a node, by label; the other symbols are known by name, path and line.
KEYS = {"Repository": ("path",), "Directory": ("path",), "File": ("path",), "Module": ("name",), "Decorator": ("name",), "Parameter": ("name", "path", "function_line_number")}
SYMBOL_KEY = ("name", "path", "line_number")
#: Columns every node has in the union view, with their types.
NODE_COLUMNS = {
    "id": "string", "label": "string", "name": "string", "path": "string", "line_number": "int", "end_line": "int", "relative_path": "string", "is_dependency": "boolean",
    "args": "array<string>", "cyclomatic_complexity": "int", "context": "string", "context_type": "string", "class_context": "string", "decorators": "array<string>", "bases": "array<string>",
    "kind": "string", "lang": "string", "is_async": "boolean", "source": "string", "docstring": "string", "value": "string", "type": "string", "alias": "string", "full_import_name": "string", "function_line_number": "int", "error": "string",
}
EDGE_COLUMNS = {"src": "string", "dst": "string", "type": "string", "line_number": "int", "args": "array<string>", "full_call_name": "string", "alias": "string", "imported_name": "string", "raw": "string"}


def check_label(label: str) -> str:
    if label not in NODE_LABELS:
        raise ValueError(f"unknown node label {label!r}")
    return label


def node_id(label: str, columns: dict[str, Column] | None = None) -> Column:
    """The key of a node as one string."""
    key = KEYS.get(label, SYMBOL_KEY)
    return F.concat_ws("\u0001", F.lit(label), *[F.coalesce((columns or {}).get(c, F.col(c)).cast("string"), F.lit("")) for c in key])


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with exactly these columns, null where it has none."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


@dataclass
class PropertyGraph:
    """nodes: by label, each with id and its own columns. edges: by type, each with src, dst and its own columns."""

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def node(self, label: str) -> DataFrame:
        found = self.nodes.get(check_label(label))
        return found if found is not None else self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items() if c != "label"))

    def edge(self, kind: str) -> DataFrame:
        if kind not in EDGE_TYPES:
            raise ValueError(f"unknown edge type {kind!r}")
        found = self.edges.get(kind)
        return found if found is not None else self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in EDGE_COLUMNS.items() if c != "type"))

    def pairs(self, kind: str) -> DataFrame:
        """The ends of edges only."""
        return self.edge(kind).select("src", "dst")

    def all_nodes(self, labels: tuple[str, ...] | None = None) -> DataFrame:
        """The union view of nodes; a filter on label reads the labels it asks for only."""
        parts = [shaped(self.node(x).withColumn("label", F.lit(x)), NODE_COLUMNS) for x in labels or tuple(self.nodes)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items()))

    def all_edges(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        parts = [shaped(self.edge(x).withColumn("type", F.lit(x)), EDGE_COLUMNS) for x in kinds or tuple(self.edges)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in EDGE_COLUMNS.items()))

    def upsert_nodes(self, label: str, rows: DataFrame) -> PropertyGraph:
        """Rows replace nodes of the same key; of rows with one key the first by all columns stays."""
        rows = rows.withColumn("id", node_id(check_label(label))).dropDuplicates(["id"])
        old = self.nodes.get(label)
        new = rows if old is None else old.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)
        return PropertyGraph(self.spark, self.nodes | {label: new}, self.edges)

    def add_edges(self, kind: str, rows: DataFrame, key: tuple[str, ...] = ("src", "dst")) -> PropertyGraph:
        """Edges with both ends present, once for each key."""
        rows = rows.dropDuplicates(list(key))
        old = self.edges.get(kind)
        new = rows if old is None else old.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)
        return PropertyGraph(self.spark, self.nodes, self.edges | {kind: new})

    def violations(self) -> DataFrame:
        """What breaks the graph's rules: (rule, name, n) for labels with ids that are not unique, and for edge types with an end that is no node. No rows if none does."""
        ids = self.all_nodes().groupBy("label", "id").agg(F.count(F.lit(1)).alias("c"))
        twice = ids.where("c > 1").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique id").alias("rule"), F.col("label").alias("name"), "n")
        ends = self.all_edges().select("type", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
        loose = ends.join(ids.select("id"), "id", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
        return twice.unionByName(loose.select(F.lit("both ends").alias("rule"), F.col("type").alias("name"), "n"))

    def write(self, path: str) -> None:
        """A table of nodes by label and one of edges by type."""
        self.all_nodes().write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.all_edges().write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")

    @staticmethod
    def read(spark: SparkSession, path: str) -> PropertyGraph:
        nodes = spark.read.schema(", ".join(f"{c} {t}" for c, t in NODE_COLUMNS.items())).parquet(f"{path}/nodes")
        edges = spark.read.schema(", ".join(f"{c} {t}" for c, t in EDGE_COLUMNS.items())).parquet(f"{path}/edges")
        return PropertyGraph(spark, {x: nodes.where(F.col("label") == x).drop("label") for x in NODE_LABELS}, {x: edges.where(F.col("type") == x).drop("type") for x in EDGE_TYPES})
