"""Patterns whose ways or pairs grow faster than the graph."""

from collections import Counter

from pyspark.sql import functions as F

from srcgraph.graph import PropertyGraph
from srcgraph.pattern import run
from srcgraph.pattern.parser import Parser
from srcgraph.pattern.planner import Plan, needed, only_counted

WAYS = "MATCH (c:Class) OPTIONAL MATCH p = (c)-[:INHERITS*]->(x:Class) RETURN c.id AS id, length(p) AS k, count(*) AS n"
NEAR = "MATCH (f:Function) WHERE f.id IN ['a', 'c'] MATCH p = (f)-[*0..2]-(x) RETURN f.id AS f, x.id AS x, length(p) AS k, count(*) AS n"


def graph(spark, label, kind, edges):
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(x, x) for x in ids], "id string, name string")
    return PropertyGraph(spark, {label: nodes}, {kind: spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, line_number int")})


def test_ways_are_counted_not_listed(spark):
    """Diamonds in a row: the last class has 2**24 ways to the first."""
    edges = [(f"{i + 1}", f"{i}{side}") for i in range(24) for side in "ab"] + [(f"{i}{side}", f"{i}") for i in range(24) for side in "ab"]
    got = {(r["id"], r["k"]): r["n"] for r in run(graph(spark, "Class", "INHERITS", edges), WAYS).collect()}
    assert got[("24", 48)] == 2**24 and got[("24", 1)] == 2 and got[("24", 2)] == 2 and got[("0", None)] == 1
    assert len(got) == 1 + sum(2 * i for i in range(1, 25)) + 2 * sum(2 * i + 1 for i in range(24))


def test_ways_round_a_cycle_use_no_edge_twice(spark):
    got = Counter({(r["id"], r["k"]): r["n"] for r in run(graph(spark, "Class", "INHERITS", [("a", "b"), ("b", "c"), ("c", "b")]), WAYS).collect()})
    assert got == Counter({("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("b", 1): 1, ("b", 2): 1, ("c", 1): 1, ("c", 2): 1})


def test_counts_of_two_hops_use_no_edge_twice(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("b", "c"), ("c", "c"), ("c", "d"), ("a", "d")]
    want = Counter()
    for f in "ac":
        want[(f, f, 0)] += 1
        ways = [(f, ())]
        for k in (1, 2):
            ways = [(b if a == at else a, (*used, i)) for at, used in ways for i, (a, b) in enumerate(edges) if at in (a, b) and i not in used]
            want.update((f, at, k) for at, _ in ways)
    assert Counter({(r["f"], r["x"], r["k"]): r["n"] for r in run(graph(spark, "Function", "CALLS", edges), NEAR).collect()}) == want


def test_paths_that_are_read_are_listed(spark):
    for text, counted in ((WAYS, True), (NEAR, True), (WAYS.replace("length(p) AS k", "p AS k"), False), (WAYS.replace("count(*)", "count(x)"), False)):
        assert only_counted(Parser(text, {}).query()) == counted


def test_only_what_is_read_of_a_node_is_joined(spark):
    """And a condition that ties a node to a bound one is met when the node is joined, before pairs of names multiply."""
    g = graph(spark, "Class", "INHERITS", [("a", "b")])
    clauses = Parser("MATCH (c:Class)-[:INHERITS]->(p:Class) WHERE c.name <> p.name RETURN p.name AS name", {}).query()
    plan = Plan(g, needed(clauses))
    plan.match(*clauses[0][1:])
    assert plan.frame.schema["c"].dataType.names == ["id", "label", "name"]
    names = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    g = PropertyGraph(spark, g.nodes | {"Function": names}, g.edges | {"CONTAINS": names.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("src"), F.col("id").alias("dst"))})
    df = run(g, "MATCH (c:Class)-[:INHERITS]->(p:Class), (c)-[:CONTAINS]->(m:Function), (p)-[:CONTAINS]->(n:Function) WHERE m.name = n.name RETURN DISTINCT m.name AS method, p.name AS parent")
    joins = [x.strip() for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert any("_a#" in x and x.count(" = ") == 2 for x in joins), joins
    assert df.count() == 3000
