"""Paths and subgraphs without a bound that the reference does not have."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from srcgraph.graph import PropertyGraph
from srcgraph.operators import traverse
from srcgraph.pattern import run

SF = "/root/testdata/sf0.001"


def test_unbounded_patterns_have_no_most_hops(spark):
    nodes = spark.range(14).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    edges = spark.range(13).select(F.concat(F.lit("f"), "id").alias("src"), F.concat(F.lit("f"), (F.col("id") + 1)).alias("dst"))
    back = edges.limit(1).select(F.lit("f13").alias("src"), F.lit("f12").alias("dst"))  # a cycle ends too, as edges are used once
    g = PropertyGraph(spark, {"Function": nodes}, {"CALLS": edges.unionByName(back)})
    pattern = "MATCH p = (a:Function {name: 'n0'})-[:CALLS*%s]->(b:Function) RETURN length(p) AS k, b.name AS b"
    want = sorted([(n, f"n{n}") for n in range(14)] + [(14, "n12")])
    got = lambda hops: sorted(tuple(r) for r in run(g, pattern % hops).collect())
    assert got("") == want[1:]


def test_subgraph_of_a_repository_has_all_rows(spark):
    repo = spark.createDataFrame([("R", "r", "/r")], "id string, name string, path string")
    held = spark.range(50_010).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("f").alias("name"), F.lit("/r/f").alias("path"))
    g = PropertyGraph(spark, {"Repository": repo, "Function": held}, {"CONTAINS": held.select(F.lit("R").alias("src"), F.col("id").alias("dst"))})
    assert traverse.subgraph(g, "/r").count() == 2 * 50_010


#: What the functions call in turn, one list an order.
ORDERS = [[0, 1, 2, 3, 4, 5], *[[0, 10]] * 3, *[[11, 5]] * 3]


@pytest.fixture
def folder(tmp_path):
    """Tables as small as they can be, with one chain of five calls from the function that calls most to the most-called one."""
    lines = [(k, n + 1, p) for k, own in enumerate(ORDERS) for n, p in enumerate(own)]
    own = {
        "part": {"p_partkey": range(12), "p_name": [f"p {i}" for i in range(12)]},
        "supplier": {"s_suppkey": [0]}, "customer": {"c_custkey": [0]}, "nation": {"n_nationkey": [0]}, "region": {"r_regionkey": [0]}, "events": {},
        "orders": {"o_orderkey": range(len(ORDERS)), "o_custkey": [0] * len(ORDERS)},
        "lineitem": {"l_orderkey": [x[0] for x in lines], "l_linenumber": [x[1] for x in lines], "l_partkey": [x[2] for x in lines], "l_suppkey": [0] * len(lines)},
    }
    plain = lambda kind: "x" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else datetime.datetime(2020, 1, 1) if pa.types.is_timestamp(kind) else datetime.date(2020, 1, 1) if pa.types.is_date(kind) else 0
    for t, columns in own.items():
        schema = pq.read_schema(f"{SF}/{t}.parquet")
        n = len(next(iter(columns.values()), [0]))
        pq.write_table(pa.table([pa.array(list(columns[f.name]) if f.name in columns else [plain(f.type)] * n, f.type) for f in schema], schema=schema.remove_metadata()), tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_call_chain_of_five_is_found(spark, folder):
    from srcgraph.plans.catalogue import QUERIES

    rows = QUERIES["call_chain"](spark, folder).collect()
    assert [(r["chain_length"], r["nodes"]) for r in rows] == [(5, "F0>F1>F2>F3>F4>F5")]
