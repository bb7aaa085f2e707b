"""The registry of graph snapshots: rows of name, full_name, version, generated_at and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(bundles: DataFrame, by: str = "generated_at") -> DataFrame:
    """The latest row of each name; of equally late ones the first by all its columns. An aggregate, so hot names are combined before they are moved."""
    others = [c for c in bundles.columns if c not in ("name", by)]
    best = bundles.groupBy("name").agg(F.max_by(F.struct(by, *others), F.struct(by)).alias("x"))
    return best.select("name", "x.*")


def find(bundles: DataFrame, name: str) -> DataFrame:
    """The bundle of a full name, else the newest of a base name."""
    exact = bundles.where(F.col("full_name") == name).withColumn("turn", F.lit(0))
    base = latest(bundles.where(F.col("name") == name)).select(*bundles.columns).withColumn("turn", F.lit(1))
    return exact.unionByName(base).orderBy("turn", F.desc("generated_at"), "full_name").limit(1).drop("turn")


def search(bundles: DataFrame, part: str = "", unique_only: bool = False) -> DataFrame:
    """Bundles whose name, repository or full name contains the text, letter case aside."""
    p = part.lower()
    hit = F.lit(False)
    for c in ("name", "repo", "full_name"):
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(p), F.lit(False))
    found = bundles.where(hit) if p else bundles
    return (latest(found).select(*bundles.columns) if unique_only else found).orderBy("name", "full_name")


def parsed(files: DataFrame) -> DataFrame:
    """Names such as 'flask-3.0-ab12cd.cgc' (bundle_name, size_bytes) as name, version, commit, full_name and size in MB."""
    bare = F.regexp_replace("bundle_name", r"\.[A-Za-z]+$", "")
    parts = F.split(bare, "-")
    get = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("unknown"))
    return files.select("*", F.get(parts, F.lit(0)).alias("name"), get(1).alias("version"), get(2).alias("commit"), bare.alias("full_name"), F.concat(F.format_number(F.col("size_bytes") / (1024 * 1024), 1), F.lit("MB")).alias("size"))


#: The suffix of snapshot files, and what a listing says where a field is missing.
SUFFIX, UNKNOWN = ".cgc", "unknown"


def listing(manifest: DataFrame, release: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """A manifest's bundles and those of the latest release (bundle_name, size_bytes, download_url, generated_at), as one list; doubles stay."""
    own = parsed(release.where(F.col("bundle_name").endswith(SUFFIX)))
    both = manifest.withColumn("source", F.lit("manifest")).unionByName(own.withColumn("source", F.lit("release")), allowMissingColumns=True)
    for c in ("version", "commit"):
        both = both.withColumn(c, F.coalesce(c, F.lit(UNKNOWN)))
    kind = F.lit(None).cast("string")
    for name, category in (categories or {}).items():
        kind = F.when(F.col("name") == name, category).otherwise(kind)
    return both.withColumn("category", F.coalesce(kind, F.lit("other"))).orderBy("name", "full_name", "source")


def by_language(nodes: DataFrame, label: str, lang: str) -> DataFrame:
    """Symbols of one label in one language, from the union view of nodes; letter case of either doesn't matter."""
    return nodes.where((F.lower("label") == label.lower()) & (F.lower("lang") == lang.lower())).select("label", "name", "path", "line_number", "lang").orderBy("path", "line_number", "name")
