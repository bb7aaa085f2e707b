"""A property graph projected from the relational test tables, so that graph queries run at any scale factor.

Each element is one SELECT that Spark and DuckDB both understand, with {table} where a table or an earlier element stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.graph import PropertyGraph

TABLES = "region nation customer supplier part orders lineitem events".split()
ELEMENTS = {
    "nsup": "SELECT count(*) AS nsup FROM {supplier}",
    "repo": "SELECT concat('R', r_regionkey) AS id, r_name AS name, concat('/', r_name) AS path, false AS is_dependency FROM {region}",
    "dir": "SELECT concat('D', n_nationkey) AS id, n_name AS name, concat('/', r_name, '/', n_name) AS path, concat('R', r_regionkey) AS up FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "file": "SELECT concat('L', s_suppkey) AS id, s_name AS name, concat('/', r_name, '/', n_name, '/', s_name) AS path, s_name AS relative_path, s_suppkey % 10 = 0 AS is_dependency, s_suppkey AS fid, concat('D', n_nationkey) AS up FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "part_": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_partkey % nsup AS fid FROM {part} CROSS JOIN {nsup}",
    "func": "SELECT concat('F', p_partkey) AS id, replace(p_name, ' ', '_') AS name, f.path AS path, cast(p_partkey AS int) AS line_number, cast(p_partkey + p_size AS int) AS end_line, cast(p_size AS int) AS cyclomatic_complexity, p_type AS context, p_brand AS lang, f.is_dependency AS is_dependency, split(p_name, ' ') AS args, split(concat('@', p_type), '#') AS decorators, concat('def ', replace(p_name, ' ', '_'), ': return ', lower(p_brand)) AS source, CASE WHEN p_size % 3 = 0 THEN concat('computes ', lower(p_type)) END AS docstring, f.id AS up, p_partkey AS pk FROM {part_} p JOIN {file} f ON p.fid = f.fid",
    "cls": "SELECT concat('C', c_custkey) AS id, c_name AS name, f.path AS path, cast(c_custkey AS int) AS line_number, cast(c_custkey + 10 AS int) AS end_line, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS context, f.is_dependency AS is_dependency, f.id AS up, c_custkey AS ck FROM (SELECT c_custkey, c_name, c_mktsegment, c_custkey % nsup AS fid FROM {customer} CROSS JOIN {nsup}) c JOIN {file} f ON c.fid = f.fid",
    "mod": "SELECT DISTINCT concat('M', p_brand) AS id, p_brand AS name, concat('pkg.', p_brand) AS full_import_name FROM {part}",
    "var": "SELECT concat('V', o_orderkey) AS id, o_orderpriority AS name, f.path AS path, cast(o_orderkey AS int) AS line_number, cast(o_orderkey % 100 AS string) AS value, f.is_dependency AS is_dependency, f.id AS up, o_orderkey AS ok, o_orderstatus AS status FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderkey % nsup AS fid FROM {orders} CROSS JOIN {nsup}) o JOIN {file} f ON o.fid = f.fid",
    "trait": "SELECT DISTINCT concat('T', c_mktsegment) AS id, c_mktsegment AS name, '/traits' AS path FROM {customer}",
    "calls": "SELECT DISTINCT concat('F', a.l_partkey) AS src, concat('F', b.l_partkey) AS dst, cast(a.l_orderkey AS int) AS line_number, a.l_returnflag AS arg FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "inherits": "SELECT concat('C', c_custkey) AS src, concat('C', cast(floor(c_custkey / 2) AS bigint)) AS dst FROM {customer} WHERE c_custkey > 0 UNION SELECT concat('C', c_custkey) AS src, concat('C', cast(floor(c_custkey / 3) AS bigint)) AS dst FROM {customer} WHERE c_custkey > 0 AND c_custkey % 3 = 0",
    "methods": "SELECT DISTINCT concat('C', o_custkey) AS src, concat('F', l_partkey) AS dst FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey",
    "imports": "SELECT concat('L', l_suppkey) AS src, concat('M', p_brand) AS dst, cast(max(l_orderkey) AS int) AS line_number, max(p_type) AS alias, min(p_type) AS imported_name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand",
    "implements": "SELECT concat('C', c_custkey) AS src, concat('T', c_mktsegment) AS dst, cast(c_custkey AS int) AS line_number FROM {customer}",
}


def with_clause(body: str) -> str:
    """body, a query over the elements, as one statement for DuckDB."""
    names = {n: n for n in (*TABLES, *ELEMENTS)}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql.format(**names)})" for n, sql in ELEMENTS.items()) + "\n" + body


#: Bytes of the tables' files for each partition that shuffles begin with. Joins and counts of strings hold many times as much.
SHARE, INITIAL = 4 << 20, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def spread(spark: SparkSession, sf_dir: str) -> None:
    """Lets shuffles begin with as many partitions as the tables ask for, so that what a task holds doesn't grow with them; small ones are merged again.

    What the session itself sets stays.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = sum(files.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")).getLength() for t in TABLES)
    most, mine = size // SHARE + 1, getattr(spark, "_spread_by_graph", None)
    if spark.conf.get(INITIAL, None) not in (None, mine):
        return
    if most > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, str(most))
        spark._spread_by_graph = str(most)
    else:
        spark.conf.unset(INITIAL)


def elements(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    spread(spark, sf_dir)
    found: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, sql in ELEMENTS.items():
        found[name] = spark.sql(sql, **{k: v for k, v in found.items() if "{" + k + "}" in sql})
    return found


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The projected graph. Orders of status P are variables that no file contains."""
    e = elements(spark, sf_dir)
    up = lambda name, parent="up": e[name].select(F.col(parent).alias("src"), F.col("id").alias("dst"))
    contains = up("dir").unionByName(up("file")).unionByName(up("func")).unionByName(up("cls")).unionByName(up("var").join(e["var"].where("status <> 'P'").select(F.col("id").alias("dst")), "dst").select("src", "dst")).unionByName(e["methods"])
    params = e["func"].select(F.col("id").alias("src"), "path", F.col("line_number").alias("function_line_number"), F.explode(F.array_distinct("args")).alias("name"))
    params = params.withColumn("id", F.concat_ws(":", F.lit("P"), "src", "name"))
    decorated = e["func"].select(F.col("id").alias("src"), "line_number", F.explode("decorators").alias("raw"))
    decorated = decorated.withColumn("name", F.expr("substring(raw, 2)")).withColumn("dst", F.concat(F.lit("@"), "name"))
    calls = e["calls"].join(e["func"].select(F.col("id").alias("dst"), "name", F.col("lang").alias("brand")), "dst")
    full = F.when(F.col("line_number") % 3 == 0, F.col("name")).when(F.col("line_number") % 3 == 1, F.concat_ws(".", "brand", "name")).otherwise(F.concat(F.lit("self."), "name"))
    calls = calls.select("src", "dst", "line_number", F.array("arg").alias("args"), full.alias("full_call_name"))
    nodes = {"Repository": e["repo"], "Directory": e["dir"].drop("up"), "File": e["file"].drop("up", "fid"), "Function": e["func"].drop("up", "pk"), "Class": e["cls"].drop("up", "ck"), "Module": e["mod"], "Variable": e["var"].drop("up", "ok", "status"), "Trait": e["trait"], "Parameter": params.drop("src"), "Decorator": decorated.select(F.col("dst").alias("id"), "name").distinct()}
    edges = {"CONTAINS": contains, "CALLS": calls, "INHERITS": e["inherits"], "IMPORTS": e["imports"], "IMPLEMENTS": e["implements"], "HAS_PARAMETER": params.select("src", F.col("id").alias("dst")), "DECORATED_BY": decorated.select("src", "dst", "line_number", "raw")}
    return PropertyGraph(spark, nodes, edges)


