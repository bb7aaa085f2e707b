"""Every query of the engine over the graph projected from the test tables, by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.extract.names import resolve_loosely
from srcgraph.functions import text
from srcgraph.graph import PropertyGraph
from srcgraph.operators import maintain, quality, relations, resolve, search, traverse
from srcgraph.operators.analyze import analyze, scopes
from srcgraph.pattern import run
from srcgraph.plans.project import elements, graph, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, over_graph: bool = True):
    """Registers f(graph) or f(spark, sf_dir) and the SQL over the projection's elements that gives the same rows."""

    def register(f):
        QUERIES[name] = (lambda spark, sf_dir: f(graph(spark, sf_dir))) if over_graph else f
        if sql:
            ORACLE_SQL[name] = with_clause(sql) if over_graph else sql
        return f

    return register


def first(df: DataFrame, *order):
    """A value that the data itself offers as a query's target."""
    r = df.orderBy(*order).first()
    return r[0] if r else ""


def most_called(g: PropertyGraph) -> str:
    top = g.edge("CALLS").groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1)
    return first(g.node("Function").join(top.select(F.col("dst").alias("id")), "id").select("name"), "name")


def most_calling(g: PropertyGraph) -> str:
    top = g.edge("CALLS").groupBy("src").count().orderBy(F.desc("count"), "src").limit(1)
    return first(g.node("Function").join(top.select(F.col("src").alias("id")), "id").select("name"), "name")


def settled(g: PropertyGraph) -> PropertyGraph:
    """The graph with its calls worked out once, for queries that read them several times."""
    return PropertyGraph(g.spark, g.nodes, g.edges | {"CALLS": traverse.cut(g.edge("CALLS"))})


def over_calls(f: Callable[[PropertyGraph], DataFrame]) -> Callable[[PropertyGraph], DataFrame]:
    return lambda g: f(settled(g))


HOT = "(SELECT f.name FROM (SELECT dst, count(*) AS c FROM calls GROUP BY dst ORDER BY c DESC, dst LIMIT 1) x JOIN func f ON f.id = x.dst)"
BUSY = "(SELECT f.name FROM (SELECT src, count(*) AS c FROM calls GROUP BY src ORDER BY c DESC, src LIMIT 1) x JOIN func f ON f.id = x.src)"
NAME = "(SELECT min(name) FROM func)"
PATH = "(SELECT min(path) FROM file)"
REPO = "(SELECT min(path) FROM repo)"
FULL = "CASE WHEN c.line_number % 3 = 0 THEN b.name WHEN c.line_number % 3 = 1 THEN concat(b.lang, '.', b.name) ELSE concat('self.', b.name) END"
NODES = """(SELECT id, 'Repository' AS label, name, path FROM repo UNION ALL SELECT id, 'Directory', name, path FROM dir UNION ALL SELECT id, 'File', name, path FROM file UNION ALL SELECT id, 'Function', name, path FROM func UNION ALL SELECT id, 'Class', name, path FROM cls
 UNION ALL SELECT id, 'Module', name, NULL FROM mod UNION ALL SELECT id, 'Variable', name, path FROM var UNION ALL SELECT id, 'Trait', name, path FROM trait UNION ALL SELECT concat('P:', id, ':', a), 'Parameter', a, path FROM (SELECT DISTINCT id, path, unnest(args) AS a FROM func) UNION ALL SELECT DISTINCT concat('@', context), 'Decorator', context, NULL FROM func)"""
CONTAINS = "(SELECT up AS src, id AS dst FROM dir UNION ALL SELECT up, id FROM file UNION ALL SELECT up, id FROM func UNION ALL SELECT up, id FROM cls UNION ALL SELECT up, id FROM var WHERE status <> 'P' UNION ALL SELECT src, dst FROM methods)"
EDGES = f"(SELECT src, dst, 'CONTAINS' AS type FROM {CONTAINS} UNION ALL SELECT src, dst, 'CALLS' FROM calls UNION ALL SELECT src, dst, 'INHERITS' FROM inherits UNION ALL SELECT src, dst, 'IMPORTS' FROM imports UNION ALL SELECT src, dst, 'IMPLEMENTS' FROM implements UNION ALL SELECT DISTINCT id, concat('P:', id, ':', a), 'HAS_PARAMETER' FROM (SELECT id, unnest(args) AS a FROM func) UNION ALL SELECT id, concat('@', context), 'DECORATED_BY' FROM func)"
PLACES = "id, name, path, line_number, is_dependency"
fn = lambda g: first(g.node("Function").select("name"), "name")
file_path = lambda g: first(g.node("File").select("path"), "path")
repo_path = lambda g: first(g.node("Repository").select("path"), "path")

# search
query("find_function_exact", f"SELECT {PLACES} FROM func WHERE name = {NAME} ORDER BY path, line_number, id LIMIT 20")(lambda g: search.by_name(g, "Function", fn(g)))
query("find_class_exact", f"SELECT {PLACES} FROM cls WHERE name = (SELECT max(name) FROM cls) ORDER BY path, line_number, id LIMIT 20")(lambda g: search.by_name(g, "Class", first(g.node("Class").select("name"), F.desc("name"))))
query("find_fuzzy_name", f"SELECT {PLACES}, levenshtein(lower(name), lower(concat({NAME}, 'x'))) AS distance FROM func WHERE levenshtein(lower(name), lower(concat({NAME}, 'x'))) <= 3 ORDER BY distance, name, path, line_number, id LIMIT 20")(lambda g: search.by_similar_name(g, "Function", fn(g) + "x", 3))
query("find_variable", f"SELECT {PLACES} FROM var WHERE contains(name, 'URG') ORDER BY is_dependency, name, path, line_number, id LIMIT 20")(lambda g: search.variables(g, "URG"))
query("find_content", f"""SELECT * FROM (SELECT {PLACES}, 'function' AS type FROM func WHERE contains(lower(name), 'ring') OR contains(lower(source), 'ring') OR contains(lower(docstring), 'ring') ORDER BY is_dependency, path, line_number, id LIMIT 20)
 UNION ALL (SELECT {PLACES}, 'class' AS type FROM cls WHERE contains(lower(name), 'ring') LIMIT 0)""")(lambda g: search.by_content(g, "ring"))
query("find_full_text", f"""SELECT id, 'Function' AS label, name, path, line_number, is_dependency, s AS score FROM (SELECT *, CASE WHEN contains(concat('_', lower(name), '_'), '_ring_') THEN 3 WHEN contains(concat(' ', replace(replace(lower(source), '_', ' '), ':', ' '), ' '), ' ring ') THEN 1 ELSE 0 END AS s FROM func) WHERE s > 0 ORDER BY s DESC, is_dependency, path, line_number, id LIMIT 20""")(lambda g: search.full_text(g, "ring"))
query("find_module", "SELECT name, full_import_name FROM mod WHERE contains(name, '1') ORDER BY name LIMIT 20")(lambda g: search.modules(g, "1"))
query("find_imports", "SELECT f.path, m.name AS module, alias, imported_name, line_number, is_dependency FROM imports i JOIN file f ON f.id = i.src JOIN mod m ON m.id = i.dst WHERE alias = (SELECT max(alias) FROM imports) OR imported_name = (SELECT max(alias) FROM imports) ORDER BY path, module, line_number LIMIT 20")(lambda g: search.imports_of(g, first(g.edge("IMPORTS").select("alias"), F.desc("alias"))))
query("find_related_ranked", f"""SELECT {PLACES}, search_type, relevance, count(*) OVER () AS total FROM (
 SELECT * FROM (SELECT {PLACES}, 'function' AS search_type, CASE WHEN is_dependency THEN 0.7 ELSE 0.9 END::DOUBLE AS relevance, 0 AS turn FROM func WHERE name = {NAME} ORDER BY path, line_number, id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT {PLACES}, 'variable', CASE WHEN is_dependency THEN 0.5 ELSE 0.7 END::DOUBLE, 2 FROM var WHERE contains(name, {NAME}) ORDER BY is_dependency, name, path, line_number, id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT {PLACES}, 'content', CASE WHEN is_dependency THEN 0.4 ELSE 0.6 END::DOUBLE, 3 FROM func WHERE contains(lower(name), {NAME}) OR contains(lower(source), {NAME}) OR contains(lower(docstring), {NAME}) ORDER BY is_dependency, path, line_number, id LIMIT 20)) ORDER BY relevance DESC, turn, path, line_number, id LIMIT 15""")(lambda g: search.related(g, fn(g)))
query("find_by_argument", f"SELECT {PLACES} FROM func WHERE list_contains(args, (SELECT max(args[1]) FROM func)) ORDER BY is_dependency, path, line_number, id LIMIT 20")(lambda g: search.by_argument(g, first(g.node("Function").select(F.col("args")[0].alias("a")), F.desc("a"))))
query("find_by_decorator", f"SELECT 'Function' AS label, {PLACES} FROM func WHERE context = (SELECT min(context) FROM func) ORDER BY is_dependency, path, line_number, id LIMIT 20")(lambda g: search.by_decorator(g, "@" + first(g.node("Function").select("context"), "context") + "(x)"))
query("find_trait_implementors", "SELECT 'Class' AS label, c.id, name, path, i.line_number AS impl_line, is_dependency FROM implements i JOIN cls c ON c.id = i.src WHERE i.dst = (SELECT min(id) FROM trait) ORDER BY path, impl_line, c.id LIMIT 50")(lambda g: search.implementors(g, first(g.node("Trait").select("name"), "name")))
query("find_by_type_function", "SELECT name, path, line_number, is_dependency FROM func ORDER BY is_dependency, name, path, line_number LIMIT 50")(lambda g: search.by_type(g, "function"))
query("find_by_type_class", "SELECT name, path, line_number, is_dependency FROM cls ORDER BY is_dependency, name, path, line_number LIMIT 50")(lambda g: search.by_type(g, "class"))
query("find_by_type_file", "SELECT name, path, is_dependency FROM file ORDER BY path LIMIT 50")(lambda g: search.by_type(g, "file"))
query("find_by_type_module", "SELECT name, name AS path, false AS is_dependency FROM mod ORDER BY name LIMIT 50")(lambda g: search.by_type(g, "module"))
query("find_name_all", f"SELECT * FROM (SELECT name, path, line_number, 'function' AS type FROM func WHERE name = {NAME} ORDER BY path, line_number, id LIMIT 20)")(lambda g: search.everything_named(g, fn(g)))
for _n, _cs, _p in (("find_pattern_ci", False, "BRAND"), ("find_pattern_cs", True, "Brand")):
    _c = "contains(name, 'Brand')" if _cs else "contains(lower(name), 'brand')"
    query(_n, f"SELECT 'Module' AS label, name, NULL::VARCHAR AS path, NULL::INT AS line_number, false AS is_dependency FROM mod WHERE {_c} ORDER BY name LIMIT 50")(lambda g, p=_p, cs=_cs: search.by_pattern(g, p, cs))

query("find_content_class", f"SELECT {PLACES}, 'class' AS type FROM cls WHERE contains(lower(name), '#00000001') ORDER BY is_dependency, path, line_number, id LIMIT 20")(lambda g: search.by_content(g, "#00000001"))
query(
    "find_pattern_mixed",
    """SELECT * FROM (SELECT 'Function' AS label, name, path, line_number, is_dependency FROM func UNION ALL SELECT 'Class', name, path, line_number, is_dependency FROM cls UNION ALL SELECT 'Module', name, NULL, NULL, false FROM mod
    UNION ALL SELECT 'Variable', name, path, line_number, is_dependency FROM var) WHERE contains(lower(name), 'r') ORDER BY is_dependency, name, label, path NULLS LAST, line_number LIMIT 2000""",
)(lambda g: search.by_pattern(g, "R", n=2000))
query(
    "find_name_all_kinds",
    f"""SELECT * FROM (SELECT name, path, line_number, 'variable' AS type FROM var WHERE contains(name, '1') ORDER BY is_dependency, name, path, line_number, id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT name, name, NULL::INT, 'module' FROM mod WHERE contains(name, '1') ORDER BY name LIMIT 20)""",
)(lambda g: search.everything_named(g, "1"))
query(
    "find_related_class",
    f"""SELECT {PLACES}, search_type, relevance, count(*) OVER () AS total FROM (
    SELECT * FROM (SELECT {PLACES}, 'class' AS search_type, CASE WHEN is_dependency THEN 0.6 ELSE 0.8 END::DOUBLE AS relevance, 1 AS turn FROM cls WHERE name = (SELECT max(name) FROM cls) ORDER BY path, line_number, id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT {PLACES}, 'content', CASE WHEN is_dependency THEN 0.4 ELSE 0.6 END::DOUBLE, 3 FROM cls WHERE contains(lower(name), lower((SELECT max(name) FROM cls))) ORDER BY is_dependency, path, line_number, id LIMIT 20)) ORDER BY relevance DESC, turn, path, line_number, id LIMIT 15""",
)(lambda g: search.related(g, first(g.node("Class").select("name"), F.desc("name"))))

# relations
CALLERS = f"SELECT DISTINCT a.name AS caller_name, a.path AS caller_path, a.line_number AS caller_line_number, a.is_dependency AS caller_is_dependency, c.line_number AS call_line, c.arg AS call_args, {FULL} AS full_call_name, b.name AS callee_name, b.path AS callee_path FROM calls c JOIN func a ON a.id = c.src JOIN func b ON b.id = c.dst"
ORDER = " ORDER BY caller_is_dependency, caller_path, caller_line_number, call_line, call_args, full_call_name, callee_path LIMIT 20"
query("who_calls", f"{CALLERS} WHERE b.name = {HOT}{ORDER}")(over_calls(lambda g: relations.callers(g, most_called(g))))
query("who_calls_in_file", f"{CALLERS} WHERE b.name = {HOT} AND b.path = (SELECT min(b.path) FROM calls c JOIN func b ON b.id = c.dst WHERE b.name = {HOT}){ORDER}")(
    over_calls(lambda g: relations.callers(g, n := most_called(g), first(g.node("Function").where(F.col("name") == n).join(g.edge("CALLS").select(F.col("dst").alias("id")), "id", "left_semi").select("path"), "path")))
)
query("what_calls", f"SELECT DISTINCT b.name AS callee_name, b.path AS callee_path, b.line_number AS callee_line_number, b.is_dependency AS callee_is_dependency, c.line_number AS call_line, c.arg AS call_args FROM calls c JOIN func a ON a.id = c.src JOIN func b ON b.id = c.dst WHERE a.name = {BUSY} ORDER BY callee_is_dependency, callee_name, callee_path, callee_line_number, call_line, call_args LIMIT 20")(over_calls(lambda g: relations.callees(g, most_calling(g))))
CLOSE = "SELECT name, path, line_number, is_dependency, min(depth)::INT AS depth FROM ({}) r JOIN func f ON f.id = r.id GROUP BY f.id, name, path, line_number, is_dependency ORDER BY is_dependency, path, line_number LIMIT 50"


def closure_sql(name: str, one: str, other: str) -> str:
    return f", e AS (SELECT DISTINCT src, dst FROM calls), lv AS (SELECT DISTINCT e.{other} AS id, 1 AS depth FROM e JOIN func f ON f.id = e.{one} WHERE f.name = {name} UNION SELECT e.{other}, lv.depth + 1 FROM lv JOIN e ON e.{one} = lv.id WHERE lv.depth < 40) " + CLOSE.format("SELECT id, depth FROM lv")


query("all_callers", closure_sql(HOT, "dst", "src"))(over_calls(lambda g: traverse.all_callers(g, most_called(g))))
query("all_callees", closure_sql(BUSY, "src", "dst"))(over_calls(lambda g: traverse.all_callees(g, most_calling(g))))
query(
    "call_chain",
    f""", e AS (SELECT c.src, c.dst, concat(c.src, '|', c.dst, '|', c.line_number, '|', c.arg, '|', {FULL}) AS eid FROM calls c JOIN func b ON b.id = c.dst),
t AS (SELECT f.id AS last, [f.id] AS nodes, []::VARCHAR[] AS cs, 0 AS n FROM func f WHERE f.name = {BUSY} UNION ALL SELECT e.dst, list_append(nodes, e.dst), list_append(cs, e.eid), n + 1 FROM t JOIN e ON e.src = t.last WHERE n < 3 AND NOT list_contains(cs, e.eid))
SELECT n::INT AS chain_length, array_to_string(nodes, '>') AS nodes, array_to_string(cs, '>') AS calls FROM t JOIN func f ON f.id = t.last WHERE n > 0 AND f.name = {HOT} ORDER BY 1, 2, 3 LIMIT 20""",
)(over_calls(lambda g: traverse.call_chains(g, most_calling(g), most_called(g))))
query("who_imports", """SELECT f.path, f.is_dependency, count(*) AS n_imports, string_agg(concat(m.name, ':', i.line_number, ':', i.alias), ';' ORDER BY m.name, i.line_number, i.alias) AS imports FROM imports i JOIN file f ON f.id = i.src JOIN mod m ON m.id = i.dst
 WHERE m.name = 'Brand#1' OR contains(m.full_import_name, 'Brand#1') GROUP BY f.path, f.is_dependency ORDER BY is_dependency, path LIMIT 20""")(lambda g: relations.importers(g, "Brand#1"))
query("who_modifies", "SELECT 'file' AS container_type, f.name AS container_name, f.path, v.line_number AS variable_line, v.value, f.is_dependency FROM var v JOIN file f ON f.id = v.up WHERE status <> 'P' AND v.name = (SELECT min(name) FROM var) ORDER BY is_dependency, path, variable_line LIMIT 20")(lambda g: relations.modifiers(g, first(g.node("Variable").select("name"), "name")))
HC = "(SELECT name FROM cls WHERE id = 'C6')"
query("class_hierarchy", f"""SELECT 'parent' AS section, p.name, p.path, p.line_number, p.is_dependency FROM inherits i JOIN cls c ON c.id = i.src JOIN cls p ON p.id = i.dst WHERE c.name = {HC} UNION SELECT 'child', p.name, p.path, p.line_number, p.is_dependency FROM inherits i JOIN cls c ON c.id = i.dst JOIN cls p ON p.id = i.src WHERE c.name = {HC}
 UNION SELECT 'method', f.name, f.path, f.line_number, f.is_dependency FROM methods m JOIN cls c ON c.id = m.src JOIN func f ON f.id = m.dst WHERE c.name = {HC}""")(lambda g: relations.hierarchy(g, first(g.node("Class").where("id = 'C6'").select("name"), "name")))
ON = "(SELECT min(f.name) FROM methods m JOIN func f ON f.id = m.dst)"
query("overrides", f"SELECT c.name AS class_name, f.name, f.path, f.line_number, f.is_dependency FROM methods m JOIN cls c ON c.id = m.src JOIN func f ON f.id = m.dst WHERE f.name = {ON} ORDER BY is_dependency, class_name, f.path, f.line_number LIMIT 20")(lambda g: relations.overrides(g, first(g.node("Function").join(g.pairs("CONTAINS").where("src like 'C%'").select(F.col("dst").alias("id")), "id", "left_semi").select("name"), "name")))
query("module_importers", "SELECT DISTINCT f.path, i.line_number, f.is_dependency FROM imports i JOIN file f ON f.id = i.src WHERE i.dst = (SELECT min(id) FROM mod) ORDER BY is_dependency, path, line_number LIMIT 50")(lambda g: relations.module_importers(g, first(g.node("Module").select("name"), "name")))
query("module_coimports", "SELECT m.name AS module, count(DISTINCT b.src) AS n_files FROM imports a JOIN imports b ON a.src = b.src AND b.dst <> a.dst JOIN mod m ON m.id = b.dst WHERE a.dst = (SELECT min(id) FROM mod) GROUP BY m.name ORDER BY module LIMIT 50")(lambda g: relations.co_imports(g, first(g.node("Module").select("name"), "name")))
query("variable_scope", "SELECT CASE WHEN status = 'P' THEN 'module' ELSE 'file' END AS scope_type, CASE WHEN status = 'P' THEN NULL ELSE f.name END AS scope_name, v.path, v.line_number, v.value, v.is_dependency FROM var v JOIN file f ON f.id = v.up WHERE v.name = (SELECT min(name) FROM var)")(lambda g: relations.variable_scope(g, first(g.node("Variable").select("name"), "name")))
query("relink_neighbours", f"SELECT DISTINCT a.path FROM calls c JOIN func a ON a.id = c.src JOIN func b ON b.id = c.dst WHERE b.path = {PATH} AND a.path <> {PATH}")(lambda g: relations.caller_files(g, file_path(g)))
query("inheritance_neighbours", f"SELECT DISTINCT p AS path FROM (SELECT CASE WHEN a.path = {PATH} THEN b.path ELSE a.path END AS p FROM inherits i JOIN cls a ON a.id = i.src JOIN cls b ON b.id = i.dst WHERE a.path = {PATH} OR b.path = {PATH}) WHERE p <> {PATH}")(lambda g: relations.inheritance_neighbours(g, file_path(g)))
query("repo_class_lookup", f"SELECT path, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM cls WHERE starts_with(path, concat({REPO}, '/')) GROUP BY path")(lambda g: relations.class_lookup(g, repo_path(g)).withColumn("names", F.array_join("names", ",")))

# quality
NOT_DEAD = "SELECT c.dst FROM calls c JOIN func a ON a.id = c.src WHERE NOT a.is_dependency"
DEAD = f"SELECT name, path, line_number FROM func WHERE NOT is_dependency AND name NOT IN ('main', 'setup', 'run') AND NOT starts_with(name, 'test_') AND NOT contains(name, 'main') AND NOT contains(lower(name), 'entry') AND NOT contains(lower(name), 'application') AND id NOT IN ({NOT_DEAD})"
query("dead_code", f"{DEAD} ORDER BY path, line_number, name LIMIT 50")(quality.dead_code)
query("dead_code_all", DEAD)(lambda g: quality.dead_code(g, n=None))
query("dead_code_excl_decorator", f"{DEAD} AND context <> (SELECT min(context) FROM func) ORDER BY path, line_number, name LIMIT 50")(lambda g: quality.dead_code(g, (first(g.node("Function").select("context"), "context"),)))
query("complexity_of", f"SELECT name, path, line_number, cyclomatic_complexity FROM func WHERE name = {NAME} ORDER BY path, line_number LIMIT 1")(lambda g: quality.complexity_of(g, fn(g)))
query("most_complex", "SELECT name, path, line_number, cyclomatic_complexity FROM func WHERE NOT is_dependency ORDER BY cyclomatic_complexity DESC, path, line_number LIMIT 10")(quality.most_complex)
query("complexity_bands", "SELECT CASE WHEN cyclomatic_complexity > 10 THEN 'red' WHEN cyclomatic_complexity > 5 THEN 'yellow' ELSE 'green' END AS band, count(*) AS n, count(*) FILTER (WHERE cyclomatic_complexity > 10) AS n_exceed FROM func WHERE NOT is_dependency GROUP BY 1")(quality.complexity_bands)
query("label_histogram", f"SELECT label, count(*) AS n FROM {NODES} GROUP BY label")(quality.label_histogram)
query("edge_histogram", f"SELECT type, count(*) AS n FROM {EDGES} GROUP BY type")(quality.edge_histogram)
query("repo_list", "SELECT name, path, is_dependency FROM repo ORDER BY name")(lambda g: g.node("Repository").select("name", "path", "is_dependency").orderBy("name"))
query("repo_stats_overall", "SELECT (SELECT count(*) FROM repo) AS repositories, (SELECT count(*) FROM file) AS files, (SELECT count(*) FROM func) AS functions, (SELECT count(*) FROM cls) AS classes, (SELECT count(*) FROM mod) AS modules")(quality.overall_stats)
query(
    "repo_stats",
    f""", k AS (SELECT src, dst FROM {CONTAINS}), w AS (SELECT r.id AS root, k.dst AS id, 1 AS d FROM repo r JOIN k ON k.src = r.id UNION ALL SELECT w.root, k.dst, d + 1 FROM w JOIN k ON k.src = w.id)
SELECT r.name, r.path, (SELECT count(*) FROM w JOIN file f USING (id) WHERE w.root = r.id) AS files, (SELECT count(*) FROM w JOIN func f USING (id) WHERE w.root = r.id) AS functions, (SELECT count(*) FROM w JOIN cls f USING (id) WHERE w.root = r.id) AS classes,
 (SELECT count(DISTINCT i.dst) FROM w JOIN imports i ON i.src = w.id WHERE w.root = r.id) AS modules FROM repo r""",
)(quality.repository_stats)
query("inheritance_depth", ", d AS (SELECT id, 0 AS n FROM cls UNION SELECT i.src, d.n + 1 FROM d JOIN inherits i ON i.dst = d.id) SELECT id, max(n)::INT AS depth FROM d GROUP BY id")(traverse.inheritance_depth)
query("subgraph_expand", f", k AS (SELECT src, dst FROM {CONTAINS}), w AS (SELECT id FROM repo WHERE path = {REPO} UNION SELECT k.dst FROM w JOIN k ON k.src = w.id) SELECT n.id, label, name, CASE WHEN label IN ('Repository', 'Class', 'Interface', 'Trait') THEN 4 ELSE 2 END AS val, e.dst, e.type AS edge_type FROM w JOIN {NODES} n USING (id) LEFT JOIN (SELECT DISTINCT src, dst, type FROM {EDGES}) e ON e.src = n.id ORDER BY n.id, edge_type NULLS FIRST, e.dst NULLS FIRST LIMIT 50000")(lambda g: traverse.subgraph(g, repo_path(g)))

# maintenance
query("orphan_peel", f", k AS (SELECT src, dst FROM {CONTAINS}), w AS (SELECT id FROM repo UNION SELECT k.dst FROM w JOIN k ON k.src = w.id) SELECT label, count(*) AS n FROM {NODES} n WHERE n.id IN (SELECT id FROM w) OR label = 'Parameter' AND EXISTS (SELECT 1 FROM w WHERE w.id = split_part(n.id, ':', 2)) OR label IN ('Module', 'Decorator') GROUP BY label")(lambda g: quality.label_histogram(maintain.clean(g)))
query("delete_repo_remaining", f"SELECT label, count(*) AS n FROM {NODES} WHERE path IS NULL OR NOT (path = {REPO} OR starts_with(path, concat({REPO}, '/'))) GROUP BY label")(lambda g: quality.label_histogram(maintain.delete_repository(g, repo_path(g))))
FID = f"(SELECT id FROM file WHERE path = {PATH})"
query("delete_file_remaining", f"SELECT type, count(*) AS n FROM {EDGES} e WHERE NOT EXISTS (SELECT 1 FROM (SELECT {FID} AS id UNION ALL SELECT dst FROM {CONTAINS} WHERE src = {FID}) x WHERE x.id = e.src OR x.id = e.dst) AND NOT (type = 'CONTAINS' AND dst IN (SELECT d.id FROM dir d WHERE (SELECT count(*) FROM file f WHERE f.up = d.id AND f.id <> {FID}) = 0 AND d.id IN (SELECT up FROM file WHERE id = {FID}))) GROUP BY type")(lambda g: quality.edge_histogram(maintain.delete_file(g, file_path(g))))
query("delete_calls_remaining", f"SELECT count(*) AS n FROM calls c JOIN func a ON a.id = c.src WHERE a.path <> {PATH}")(lambda g: maintain.delete_calls_from(g, g.node("File").where(F.col("path") == file_path(g))).edge("CALLS").agg(F.count(F.lit(1)).alias("n")))
query("indexed_files", f"SELECT count(DISTINCT path) AS n_files FROM file WHERE starts_with(path, concat({REPO}, '/'))")(lambda g: maintain.indexed_files(g, repo_path(g)))
query("ignore_dirs_filter", "SELECT name, path FROM file WHERE NOT contains(path, '/ASIA/')")(lambda g: g.node("File").where(~text.ignored(F.col("path"), ("ASIA",))).select("name", "path"))
query("normalise_decorators", "SELECT id, context AS decorator FROM func")(lambda g: g.node("Function").select("id", text.normalised_decorator(F.concat(F.col("decorators")[0], F.lit("(x=1)"))).alias("decorator")))
query("path_tree_directories", "SELECT path, count(*) AS n FROM (SELECT concat('/', split_part(path, '/', 2)) AS path FROM file UNION ALL SELECT concat('/', split_part(path, '/', 2), '/', split_part(path, '/', 3)) FROM file) GROUP BY path")(
    lambda g: g.node("File").select(F.explode(F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
)
query("dominant_type_coerce", "SELECT name AS key, kind AS dominant, n FROM (SELECT name, kind, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, kind) AS r FROM (SELECT name, CASE WHEN value::INT % 3 = 0 THEN 'Integer' ELSE 'String' END AS kind FROM var) GROUP BY name, kind) WHERE r = 1")(
    lambda g: quality.dominant_type(g.node("Variable").select(F.col("name").alias("key"), F.when(F.col("value").cast("int") % 3 == 0, "Integer").otherwise("String").alias("kind")), "key", "kind")
)

query(
    "coerced_values",
    """, k AS (SELECT id, name, value, CASE WHEN value::INT % 3 = 0 THEN 'Integer' ELSE 'String' END AS kind FROM var), u AS (SELECT value[1:1] AS lk, kind, count(*) AS c FROM k GROUP BY 1, 2), d AS (SELECT lk, kind AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY c DESC, kind) AS r FROM u) WHERE r = 1)
    SELECT id, dominant, CASE WHEN dominant = 'Integer' THEN coalesce(try_cast(CASE WHEN kind = 'String' THEN concat('x', value) ELSE value END AS BIGINT), 0)::VARCHAR ELSE CASE WHEN kind = 'String' THEN concat('x', value) ELSE value END END AS coerced FROM k JOIN d ON d.lk = value[1:1]""",
)(lambda g: quality.coerced(typed_values(g), "key", "kind", "text").select("id", "dominant", "coerced"))
query("schema_violations", f"SELECT 'both ends' AS rule, type AS name, count(*) AS n FROM (SELECT DISTINCT type, src, dst, unnest(list_distinct([src, dst])) AS id FROM (SELECT DISTINCT * FROM {EDGES})) WHERE id NOT IN (SELECT id FROM {NODES} WHERE label <> 'Trait') GROUP BY type")(lambda g: hanging(g).violations())
query("loose_resolution", """, s AS (SELECT id, name, path, 'Function' AS label, pk AS ord FROM func UNION ALL SELECT id, name, path, 'Class', ck FROM cls), q AS (SELECT f.id AS caller, f.path, b.name FROM calls c JOIN func b ON b.id = c.dst JOIN file f ON f.path = (SELECT path FROM func a WHERE a.id = c.src)),
    r AS (SELECT DISTINCT caller, coalesce((SELECT min(id) FROM s WHERE s.name = q.name AND label = 'Function' HAVING count(*) = 1), (SELECT arg_min(id, ord) FROM s WHERE s.name = q.name AND s.path = q.path AND label = 'Function'), (SELECT arg_min(id, ord) FROM s WHERE s.name = q.name AND label = 'Function')) AS target FROM (SELECT DISTINCT * FROM q) q)
    SELECT caller, target FROM r WHERE target <> caller""")(lambda g: loosely(g))

# catalogue of documented patterns
query("cookbook_08_decorated_classes", "SELECT name, path FROM func WHERE context = (SELECT max(context) FROM func)")(lambda g: g.node("Function").where(F.array_contains("decorators", F.lit("@" + first(g.node("Function").select("context"), F.desc("context"))))).select("name", "path"))
query("cookbook_15_imported_modules", "SELECT DISTINCT m.name FROM imports i JOIN mod m ON m.id = i.dst JOIN file f ON f.id = i.src WHERE ends_with(f.path, '1')")(lambda g: g.edge("IMPORTS").join(g.node("File").where(F.col("path").endswith("1")).select(F.col("id").alias("src")), "src", "left_semi").join(g.node("Module").select(F.col("id").alias("dst"), "name"), "dst").select("name").distinct())
query("cookbook_21_functions_in_file", f"SELECT name, line_number FROM func WHERE ends_with(path, (SELECT relative_path FROM file WHERE path = {PATH}))")(lambda g: g.node("Function").where(F.col("path").endswith(text_of(g))).select("name", "line_number"))
query("cookbook_26_many_arguments", "SELECT name, len(args)::INT AS n_args FROM func WHERE len(args) > 1")(lambda g: g.node("Function").where(F.size("args") > 1).select("name", F.size("args").alias("n_args")))
query("cookbook_27_docstrings", "SELECT name, docstring FROM func WHERE docstring IS NOT NULL AND docstring <> ''")(lambda g: g.node("Function").where("docstring is not null and docstring <> ''").select("name", "docstring"))
query("cookbook_32_functions_per_file", "SELECT f.path, count(*) AS n FROM func x JOIN file f ON f.id = x.up GROUP BY f.path")(lambda g: g.pairs("CONTAINS").join(g.node("File").select(F.col("id").alias("src"), "path"), "src").join(g.node("Function").select(F.col("id").alias("dst")), "dst").groupBy("path").agg(F.count(F.lit(1)).alias("n")))
query("cookbook_33_overriding_methods", "SELECT DISTINCT a.name AS child, b.name AS parent, f.name AS method FROM inherits i JOIN cls a ON a.id = i.src JOIN cls b ON b.id = i.dst JOIN methods m ON m.src = a.id JOIN func f ON f.id = m.dst JOIN methods n ON n.src = b.id JOIN func h ON h.id = n.dst WHERE f.name = h.name")(lambda g: overriding(g))
query("cookbook_34_self_calls", f"SELECT a.name, count(*) AS n FROM calls c JOIN func a ON a.id = c.src JOIN func b ON b.id = c.dst WHERE starts_with({FULL}, 'self.') GROUP BY a.name")(lambda g: g.edge("CALLS").where(F.col("full_call_name").startswith("self.")).join(g.node("Function").select(F.col("id").alias("src"), "name"), "src").groupBy("name").agg(F.count(F.lit(1)).alias("n")))
query("cookbook_35_calls_with_argument", "SELECT a.name, c.line_number FROM calls c JOIN func a ON a.id = c.src WHERE c.arg = 'R'")(lambda g: g.edge("CALLS").where(F.array_contains("args", "R")).join(g.node("Function").select(F.col("id").alias("src"), "name"), "src").select("name", "line_number"))
query("cookbook_36_uncalled", "SELECT id, name FROM func WHERE id NOT IN (SELECT dst FROM calls)")(lambda g: g.node("Function").join(g.edge("CALLS").select(F.col("dst").alias("id")), "id", "left_anti").select("id", "name"))
query("cookbook_41_long_functions", "SELECT name, end_line - line_number AS lines FROM func WHERE end_line - line_number > 20")(lambda g: g.node("Function").select("name", (F.col("end_line") - F.col("line_number")).alias("lines")).where("lines > 20"))
query("cookbook_42_recursive", "SELECT DISTINCT a.name, a.path FROM calls c JOIN func a ON a.id = c.src JOIN func b ON b.id = c.dst WHERE a.name = b.name AND a.path = b.path")(lambda g: recursive(g))
query(
    "cookbook_43_hubs",
    ", o AS (SELECT src AS id, count(DISTINCT dst) AS d FROM calls GROUP BY src), i AS (SELECT dst AS id, count(DISTINCT src) AS d FROM calls GROUP BY dst) SELECT f.id, f.name, coalesce(o.d, 0) + coalesce(i.d, 0) AS degree FROM func f LEFT JOIN o ON o.id = f.id LEFT JOIN i ON i.id = f.id ORDER BY degree DESC, f.id LIMIT 5",
)(lambda g: hubs(g))
query("cookbook_44_secrets", "SELECT name, path FROM func WHERE contains(lower(source), 'brand#1') OR contains(lower(source), 'token')")(lambda g: g.node("Function").where(F.exists(F.array(F.lit("brand#1"), F.lit("token")), lambda k: F.contains(F.lower(F.col("source")), k))).select("name", "path"))


# documented queries in the pattern language itself
def pattern(name: str, text: str, sql: str, params: Callable[[PropertyGraph], dict] = lambda g: {}) -> None:
    """Registers a query text, run as a user would."""
    query(name, sql)(lambda g: run(g, text, params(g)))


pattern(
    "cookbook_19_functions",
    "MATCH (n:Function) RETURN n.name AS name, n.path AS path, n.line_number AS line_number ORDER BY path, line_number LIMIT 50",
    "SELECT name, path, line_number FROM func ORDER BY path, line_number LIMIT 50",
)
pattern(
    "cookbook_20_classes",
    "MATCH (n:Class) RETURN n.name AS name, n.path AS path, n.line_number AS line_number ORDER BY path, line_number LIMIT 50",
    "SELECT name, path, line_number FROM cls ORDER BY path, line_number LIMIT 50",
)
pattern(
    "cookbook_22_classes_in_file",
    "MATCH (c:Class) WHERE c.path ENDS WITH $file RETURN c.name AS name",
    f"SELECT name FROM cls WHERE ends_with(path, (SELECT relative_path FROM file WHERE path = {PATH}))",
    lambda g: {"file": text_of(g)},
)
pattern(
    "cookbook_23_top_level_symbols",
    "MATCH (f:File)-[:CONTAINS]->(n) WHERE f.path ENDS WITH $end AND (n:Function OR n:Class) AND n.context IS NULL RETURN n.name AS name",
    "SELECT c.name FROM cls c JOIN file f ON f.id = c.up WHERE ends_with(f.path, '1') AND c.context IS NULL",
    lambda g: {"end": "1"},
)
pattern(
    "cookbook_24_calls_between_files",
    "MATCH (caller:Function)-[:CALLS]->(callee:Function {name: $name}) WHERE caller.path ENDS WITH '1' AND callee.path ENDS WITH '2' RETURN caller.name AS caller, caller.path AS path",
    f"SELECT a.name AS caller, a.path FROM calls c JOIN func a ON a.id = c.src JOIN func b ON b.id = c.dst WHERE b.name = {NAME} AND ends_with(a.path, '1') AND ends_with(b.path, '2')",
    lambda g: {"name": fn(g)},
)
pattern(
    "cookbook_25_circular_imports",
    """MATCH (f1:File)-[:IMPORTS]->(m2:Module), (f2:File)-[:IMPORTS]->(m1:Module)
       WHERE 'Brand#' + toString(toInteger(split(f1.name, '#')[1])) = m1.name AND 'Brand#' + toString(toInteger(split(f2.name, '#')[1])) = m2.name RETURN DISTINCT f1.name AS one, f2.name AS other""",
    """, n AS (SELECT id, name, concat('Brand#', split_part(name, '#', 2)::BIGINT) AS module FROM file)
    SELECT DISTINCT a.name AS one, b.name AS other FROM imports i JOIN n a ON a.id = i.src JOIN mod m2 ON m2.id = i.dst JOIN n b ON b.module = m2.name JOIN imports j ON j.src = b.id JOIN mod m1 ON m1.id = j.dst AND m1.name = a.module""",
)
pattern(
    "cookbook_28_classes_with_method",
    "MATCH (c:Class)-[:CONTAINS]->(m:Function {name: $name}) RETURN DISTINCT c.name AS name, c.path AS path",
    f"SELECT DISTINCT c.name, c.path FROM methods m JOIN cls c ON c.id = m.src JOIN func f ON f.id = m.dst WHERE f.name = {NAME}",
    lambda g: {"name": fn(g)},
)
pattern(
    "cookbook_29_inheritance_paths",
    "MATCH (c:Class) OPTIONAL MATCH path = (c)-[:INHERITS*]->(parent:Class) RETURN c.id AS id, length(path) AS depth, count(*) AS n",
    """, p AS (SELECT i.src AS id, i.dst AS at, 1 AS depth FROM inherits i UNION ALL SELECT p.id, i.dst, depth + 1 FROM p JOIN inherits i ON i.src = p.at)
    SELECT c.id, p.depth, count(*) AS n FROM cls c LEFT JOIN (SELECT p.* FROM p JOIN cls x ON x.id = p.at) p USING (id) GROUP BY ALL""",
)
pattern(
    "cookbook_31_decorated_methods",
    "MATCH (c:Class {name: $name})-[:CONTAINS]->(m:Function) WHERE m.decorators IS NOT NULL AND size(m.decorators) > 0 RETURN m.name AS name, m.path AS path",
    "SELECT f.name, f.path FROM methods m JOIN cls c ON c.id = m.src JOIN func f ON f.id = m.dst WHERE c.name = (SELECT max(name) FROM cls)",
    lambda g: {"name": first(g.node("Class").select("name"), F.desc("name"))},
)
pattern(
    "cookbook_33_overriding_by_pattern",
    "MATCH (c:Class)-[:INHERITS]->(p:Class), (c)-[:CONTAINS]->(m:Function), (p)-[:CONTAINS]->(n:Function) WHERE m.name = n.name RETURN DISTINCT m.name AS method, c.name AS child, p.name AS parent",
    """SELECT DISTINCT f.name AS method, a.name AS child, b.name AS parent FROM inherits i JOIN cls a ON a.id = i.src JOIN cls b ON b.id = i.dst JOIN methods m ON m.src = a.id JOIN func f ON f.id = m.dst
    JOIN methods n ON n.src = b.id JOIN func h ON h.id = n.dst WHERE f.name = h.name""",
)
pattern(
    "cookbook_40_modules_of_file",
    "MATCH (f:File {name: $name})-[:IMPORTS]->(m:Module) RETURN m.name AS imported_module_name",
    "SELECT m.name AS imported_module_name FROM imports i JOIN file f ON f.id = i.src JOIN mod m ON m.id = i.dst WHERE f.name = (SELECT min(name) FROM file)",
    lambda g: {"name": first(g.node("File").select("name"), "name")},
)
pattern(
    "pattern_labels",
    "CALL db.labels() YIELD label MATCH (n:Repository) RETURN label, count(n) AS repositories",
    f"SELECT DISTINCT label, (SELECT count(*) FROM repo) AS repositories FROM {NODES}",
)
pattern(
    "pattern_full_text",
    "CALL db.index.fulltext.queryNodes('code_search_index', $term) YIELD node, score WHERE node:Function RETURN node.id AS id, score",
    "SELECT * FROM (SELECT id, CASE WHEN contains(concat('_', lower(name), '_'), '_ring_') THEN 3 WHEN contains(concat(' ', replace(replace(lower(source), '_', ' '), ':', ' '), ' '), ' ring ') THEN 1 ELSE 0 END AS score FROM func) WHERE score > 0",
    lambda g: {"term": "ring"},
)
UNDIRECTED = f", e AS (SELECT *, row_number() OVER () AS r FROM {EDGES}), u AS (SELECT src AS a, dst AS b, r FROM e UNION ALL SELECT dst, src, r FROM e WHERE src <> dst)"
query(
    "cookbook_43_hub_neighbourhood",
    f"""{UNDIRECTED}, o AS (SELECT src AS id, count(DISTINCT dst) AS d FROM calls GROUP BY src), i AS (SELECT dst AS id, count(DISTINCT src) AS d FROM calls GROUP BY dst),
    h AS (SELECT f.id FROM func f LEFT JOIN o ON o.id = f.id LEFT JOIN i ON i.id = f.id ORDER BY coalesce(o.d, 0) + coalesce(i.d, 0) DESC, f.id LIMIT 5),
    p AS (SELECT id AS hub, id AS node, 0 AS hops, 0 AS r FROM h UNION ALL SELECT h.id, u.b, 1, u.r FROM h JOIN u ON u.a = h.id),
    q AS (SELECT * FROM p UNION ALL SELECT p.hub, u.b, 2, u.r FROM p JOIN u ON u.a = p.node AND u.r <> p.r WHERE p.hops = 1)
    SELECT hub, node, hops, count(*) AS n FROM q GROUP BY ALL""",
)(over_calls(lambda g: run(g, "MATCH (f:Function) WHERE f.id IN $hubs MATCH p = (f)-[*0..2]-(x) RETURN f.id AS hub, x.id AS node, length(p) AS hops, count(*) AS n", {"hubs": [r["id"] for r in hubs(g).collect()]})))

# all relations through one entry
query("analyze_find_callers", f"SELECT caller_name, caller_path, call_line FROM ({CALLERS} WHERE b.name = {HOT}{ORDER})")(over_calls(lambda g: analyze(g, "find_callers", most_called(g)).results.select("caller_name", "caller_path", "call_line")))
query("analyze_overrides", f"SELECT c.name AS class_name, f.name, f.path, f.line_number, f.is_dependency FROM methods m JOIN cls c ON c.id = m.src JOIN func f ON f.id = m.dst WHERE f.name = {ON} ORDER BY is_dependency, class_name, f.path, f.line_number LIMIT 20")(
    lambda g: analyze(g, "Polymorphism ", first(g.node("Function").join(g.pairs("CONTAINS").where("src like 'C%'").select(F.col("dst").alias("id")), "id", "left_semi").select("name"), "name")).results
)
query("analyze_complexity", "SELECT name, path, line_number, cyclomatic_complexity FROM func WHERE NOT is_dependency ORDER BY cyclomatic_complexity DESC, path, line_number LIMIT 7")(lambda g: analyze(g, "find_complexity", context="7").results)
query("variable_scope_groups", "SELECT CASE WHEN status = 'P' THEN 'module' ELSE 'file' END AS scope_type, count(*) AS n FROM var WHERE name = (SELECT min(name) FROM var) GROUP BY 1")(
    lambda g: scopes(g, first(g.node("Variable").select("name"), "name")).select("scope_type", "n")
)
query("deleted_links", f"SELECT 'CALLS' AS type, count(*) AS n FROM calls c JOIN func a ON a.id = c.src WHERE starts_with(a.path, concat({REPO}, '/')) UNION ALL SELECT 'INHERITS', count(*) FROM inherits i JOIN cls a ON a.id = i.src WHERE starts_with(a.path, concat({REPO}, '/'))")(
    lambda g: maintain.delete_links(g, repo_path(g))[1]
)

# names to symbols across files, over parse rows made of the tables
PARSED = """, fn AS (SELECT pk, path, CASE WHEN pk IN (SELECT min(pk) FROM func GROUP BY name) THEN concat(name, '_', lower(replace(lang, '#', ''))) ELSE name END AS name FROM func),
 cl AS (SELECT ck, path, concat(split_part(name, '#', 1), '_', ck // 3) AS name FROM cls),
 im AS (SELECT DISTINCT s.path, p.name AS key, concat(replace(ltrim(p.path, '/'), '/', '.'), '.', p.name) AS full_name FROM lineitem JOIN fn p ON p.pk = l_partkey JOIN file s ON s.fid = l_suppkey WHERE l_linestatus = 'F' AND l_returnflag = 'R'),
 imports_ AS (SELECT path, key, max(full_name) AS full_name FROM im GROUP BY path, key),
 cs AS (SELECT DISTINCT s.path, p.name, CASE l_returnflag WHEN 'R' THEN p.name WHEN 'A' THEN concat('self.', p.name) ELSE concat('obj.', p.name) END AS full_name, l_orderkey AS line FROM lineitem JOIN fn p ON p.pk = l_partkey JOIN file s ON s.fid = l_suppkey),
 ix AS (SELECT DISTINCT name, path FROM (SELECT name, path FROM fn UNION ALL SELECT name, path FROM cl)),
 by_ AS (SELECT name, count(*) AS files, min(path) AS first FROM ix GROUP BY name),
 th AS (SELECT i.path AS caller, i.key, min(x.path) AS through FROM imports_ i JOIN ix x ON x.name = i.key WHERE contains(concat(x.path, '/'), concat('/', replace(i.full_name, '.', '/'), '/')) OR contains(concat(x.path, '/'), concat('/', regexp_replace(replace(i.full_name, '.', '/'), '/[^/]*$', ''), '/')) GROUP BY i.path, i.key),
 any_ AS (SELECT c.path, c.name, min(x.path) AS rescued FROM (SELECT DISTINCT path, name FROM cs) c JOIN imports_ i ON i.path = c.path JOIN ix x ON x.name = c.name AND (contains(concat(x.path, '/'), concat('/', replace(i.full_name, '.', '/'), '/')) OR contains(concat(x.path, '/'), concat('/', regexp_replace(replace(i.full_name, '.', '/'), '/[^/]*$', ''), '/'))) GROUP BY c.path, c.name),
 lk AS (SELECT *, CASE WHEN contains(full_name, '.') THEN split_part(full_name, '.', 1) END AS base, coalesce(CASE WHEN contains(full_name, '.') THEN split_part(full_name, '.', 1) END, name) AS lookup FROM cs),
 res AS (SELECT lk.path, lk.name, lk.full_name, lk.line, coalesce(CASE WHEN base = 'self' THEN lk.path WHEN l.path IS NOT NULL THEN lk.path WHEN b.files = 1 THEN b.first WHEN b.files > 1 THEN th.through END, h.path, any_.rescued) AS sure, f.first
  FROM lk LEFT JOIN ix l ON l.path = lk.path AND l.name = lk.lookup LEFT JOIN by_ b ON b.name = lk.lookup LEFT JOIN th ON th.caller = lk.path AND th.key = lk.lookup LEFT JOIN ix h ON h.path = lk.path AND h.name = lk.name LEFT JOIN any_ ON any_.path = lk.path AND any_.name = lk.name LEFT JOIN by_ f ON f.name = lk.name)
"""


def parse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse rows, a file for each supplier: parts are its functions, customers its classes, line items its calls and imports."""
    e = elements(spark, sf_dir)
    firsts = e["func"].groupBy("name").agg(F.min("pk").alias("pk")).select("pk", F.lit(True).alias("unlike"))
    f = e["func"].join(firsts, "pk", "left")
    f = f.select("pk", "path", F.when(F.col("unlike"), F.concat("name", F.lit("_"), F.lower(F.replace("lang", F.lit("#"), F.lit(""))))).otherwise(F.col("name")).alias("name"))
    c = e["cls"].select("path", F.concat(F.split_part("name", F.lit("#"), F.lit(1)), F.lit("_"), F.floor(F.col("ck") / 3).cast("string")).alias("name"), F.concat(F.split_part("name", F.lit("#"), F.lit(1)), F.lit("_"), F.floor(F.col("ck") / 7).cast("string")).alias("base"))
    s = e["file"].select(F.col("fid").alias("l_suppkey"), "path")
    met = e["lineitem"].join(f.select(F.col("pk").alias("l_partkey"), "name", F.col("path").alias("at")), "l_partkey").join(s, "l_suppkey")
    flag = F.col("l_returnflag")
    full = F.when(flag == "R", F.col("name")).when(flag == "A", F.concat(F.lit("self."), "name")).otherwise(F.concat(F.lit("obj."), "name"))
    call = F.struct("name", full.alias("full_name"), F.col("l_orderkey").cast("int").alias("line_number"), F.array().cast("array<string>").alias("args"), F.lit(None).cast("string").alias("inferred_obj_type"), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("line")).alias("context"))
    calls = met.select("path", call.alias("c")).distinct().groupBy("path").agg(F.collect_list("c").alias("function_calls"))
    module = F.replace(F.expr("substring(at, 2)"), F.lit("/"), F.lit("."))
    imports = met.where("l_linestatus = 'F' and l_returnflag = 'R'").select("path", F.struct("name", F.concat(module, F.lit("."), "name").alias("full_import_name"), F.lit(None).cast("string").alias("alias")).alias("i")).distinct()
    imports = imports.groupBy("path").agg(F.array_sort(F.collect_list("i")).alias("imports"))  # so the greatest full name is the last of a key
    functions = f.groupBy("path").agg(F.collect_list(F.struct("name")).alias("functions"))
    classes = c.groupBy("path").agg(F.collect_list(F.struct("name", F.array("base").alias("bases"))).alias("classes"))
    out = e["file"].select("path", F.lit("python").alias("lang")).join(functions, "path", "left").join(classes, "path", "left").join(calls, "path", "left").join(imports, "path", "left")
    for name in ("functions", "classes", "function_calls", "imports"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def over_rows(name: str, sql: str):
    """Registers f(parse rows) and its SQL over PARSED."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(traverse.cut(parse_rows(spark, sf_dir)))
        ORACLE_SQL[name] = with_clause(PARSED + sql)
        return f

    return register


over_rows("symbol_index", "SELECT name, path FROM ix")(lambda rows: resolve.symbol_index(rows).select("name", "path"))
over_rows("resolve_calls", "SELECT path, name AS called_name, full_name AS full_call_name, line::INT AS line_number, coalesce(sure, first, path) AS called_path, sure IS NULL AS external FROM res")(
    lambda rows: resolve.resolve_calls(rows).select("path", "called_name", "full_call_name", "line_number", "called_path", "external")
)
over_rows("skip_external_calls", "SELECT path, name AS called_name, line::INT AS line_number, sure AS called_path FROM res WHERE sure IS NOT NULL")(
    lambda rows: resolve.resolve_calls(rows, skip_external=True).select("path", "called_name", "line_number", "called_path")
)
over_rows(
    "resolve_inheritance",
    """, b AS (SELECT DISTINCT c.path, concat(split_part(c.name, '#', 1), '_', ck // 3) AS child, concat(split_part(c.name, '#', 1), '_', ck // 7) AS parent FROM cls c),
    n AS (SELECT name, count(DISTINCT path) AS files, min(path) AS one FROM cl GROUP BY name)
    SELECT b.path, child, parent, CASE WHEN l.path IS NOT NULL THEN b.path ELSE one END AS parent_path FROM b LEFT JOIN (SELECT DISTINCT path, name FROM cl) l ON l.path = b.path AND l.name = b.parent LEFT JOIN n ON n.name = b.parent WHERE l.path IS NOT NULL OR files = 1""",
)(resolve.resolve_inheritance)


def typed_values(g: PropertyGraph) -> DataFrame:
    """Values of variables as texts of two types: those that three divides are integers, the others start with a letter."""
    v = g.node("Variable")
    integer = F.col("value").cast("int") % 3 == 0
    return v.select("id", F.substring("value", 1, 1).alias("key"), F.when(integer, "Integer").otherwise("String").alias("kind"), F.when(integer, F.col("value")).otherwise(F.concat(F.lit("x"), "value")).alias("text"))


def hanging(g: PropertyGraph) -> PropertyGraph:
    """The graph without its traits, and with one edge of each pair and type: edges to traits have no end."""
    return PropertyGraph(g.spark, {k: n for k, n in g.nodes.items() if k != "Trait"}, {k: e.select("src", "dst").distinct() for k, e in g.edges.items()})


def loosely(g: PropertyGraph) -> DataFrame:
    """Calls from files, by the called functions' names, as the loose rule resolves them."""
    f, c = g.node("Function"), g.node("Class")
    symbols = f.select("id", F.lit("Function").alias("label"), "name", "path", F.col("line_number").alias("ord")).unionByName(c.select("id", F.lit("Class").alias("label"), "name", "path", F.col("line_number").alias("ord")))
    calls = g.pairs("CALLS").join(f.select(F.col("id").alias("src"), "path"), "src").join(f.select(F.col("id").alias("dst"), "name"), "dst")
    return resolve_loosely(calls.join(g.node("File").select(F.col("id").alias("caller"), "path"), "path").select("caller", "name", "path"), symbols)


def text_of(g: PropertyGraph) -> str:
    return first(g.node("File").where(F.col("path") == file_path(g)).select("relative_path"), "relative_path")


def overriding(g: PropertyGraph) -> DataFrame:
    c, held = g.node("Class").select("id", "name"), g.pairs("CONTAINS").join(g.node("Function").select(F.col("id").alias("dst"), F.col("name").alias("method")), "dst").select("src", "method").distinct()
    e = g.pairs("INHERITS").join(held, "src").join(held.select(F.col("src").alias("dst"), "method"), ["dst", "method"])
    return e.join(c.select(F.col("id").alias("src"), F.col("name").alias("child")), "src").join(c.select(F.col("id").alias("dst"), F.col("name").alias("parent")), "dst").select("child", "parent", "method").distinct()


def recursive(g: PropertyGraph) -> DataFrame:
    f = g.node("Function")
    a, b = f.select(F.col("id").alias("src"), "name", "path"), f.select(F.col("id").alias("dst"), "name", "path")
    return g.edge("CALLS").select("src", "dst").join(a, "src").join(b, ["dst", "name", "path"]).select("name", "path").distinct()


def hubs(g: PropertyGraph, n: int = 5) -> DataFrame:
    ends = g.edge("CALLS").select("src", "dst").distinct()
    both = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return g.node("Function").join(both, "id", "left").select("id", "name", F.coalesce("d", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(n)


@query("latest_bundle_per_name", "SELECT p_name AS name, max(p_partkey) AS version, arg_max(p_brand, p_partkey) AS source FROM part GROUP BY p_name", over_graph=False)
def latest_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcgraph.operators.registry import latest

    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("version"), F.col("p_brand").alias("source"))
    return latest(rows, "version").select("name", "version", "source")


DEBOUNCE = """
WITH e AS (SELECT concat('u', user_id) AS path, ts, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'removed' ELSE 'modified' END AS kind FROM events),
g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT path, epoch_ms(min(ts)) AS first_ms, count(*) AS n_events, arg_max(kind, ts) AS action FROM s GROUP BY path, n
"""


@query("watch_debounce", DEBOUNCE, over_graph=False)
def watch_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    from srcgraph.streaming.watch import debounced, events_of

    # by the fields of the local time, so that the session's time zone plays no part
    day = F.unix_date(F.col("start").cast("date")).cast("long")
    ms = (day * 24 + F.hour("start")) * 3_600_000 + F.minute("start") * 60_000 + F.round(F.date_part(F.lit("SECOND"), F.col("start")) * 1000).cast("long")
    return debounced(events_of(spark.read.parquet(f"{sf_dir}/events.parquet")), "6 hours").select("path", ms.alias("first_ms"), "n_events", "action")


@query("latest_by_window", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1", over_graph=False)
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins, on the orders of a customer."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return o.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")
