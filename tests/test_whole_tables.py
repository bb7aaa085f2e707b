"""The projected graph and queries over it against brute force over all rows of the tables."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return {t: pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("part", "orders", "lineitem", "supplier")}


@pytest.fixture(scope="module")
def calls(tables):
    """(caller, callee, line, argument), each once."""
    at = {}
    for r in tables["lineitem"]:
        at.setdefault((r["l_orderkey"], r["l_linenumber"]), []).append(r)
    return {(a["l_partkey"], b["l_partkey"], k, a["l_returnflag"]) for (k, n), rows in at.items() for a in rows for b in at.get((k, n + 1), ())}


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_edges_are_built_from_all_rows(spark, tables, calls):
    from srcgraph.plans.project import graph

    g = graph(spark, SF)
    assert Counter(pairs(g.edge("CALLS"), "src", "dst", "line_number")) == Counter((f"F{a}", f"F{b}", k) for a, b, k, _ in calls)
    buyer = {r["o_orderkey"]: r["o_custkey"] for r in tables["orders"]}
    held = {(f"C{buyer[r['l_orderkey']]}", f"F{r['l_partkey']}") for r in tables["lineitem"] if r["l_orderkey"] in buyer}
    assert Counter(pairs(g.edge("CONTAINS").where("src like 'C%'"), "src", "dst")) == Counter(held)
    brand = {r["p_partkey"]: r["p_brand"] for r in tables["part"]}
    assert Counter(pairs(g.edge("IMPORTS"), "src", "dst")) == Counter({(f"L{r['l_suppkey']}", f"M{brand[r['l_partkey']]}") for r in tables["lineitem"] if r["l_partkey"] in brand})


def test_uncalled_and_dead_code(spark, tables, calls):
    from srcgraph.plans.catalogue import QUERIES

    name = {r["p_partkey"]: r["p_name"].replace(" ", "_") for r in tables["part"]}
    called = {b for _, b, _, _ in calls}
    assert Counter(pairs(QUERIES["cookbook_36_uncalled"](spark, SF), "id")) == Counter((f"F{p}",) for p in name if p not in called)
    n = len(tables["supplier"])
    outside = lambda p: p % n % 10 == 0
    used = {b for a, b, _, _ in calls if not outside(a)}
    dull = lambda x: x in ("setup", "run") or x.startswith("test_") or "main" in x or "entry" in x.lower() or "application" in x.lower()
    assert Counter(pairs(QUERIES["dead_code_all"](spark, SF), "name", "line_number")) == Counter((x, p) for p, x in name.items() if not outside(p) and p not in used and not dull(x))


def test_closure_of_callers(spark, tables, calls):
    from srcgraph.operators.traverse import all_callers
    from srcgraph.plans.project import graph

    name = {r["p_partkey"]: r["p_name"].replace(" ", "_") for r in tables["part"]}
    target = min(name.values())
    depth, now, n = {}, {p for p, x in name.items() if x == target}, 0
    while now:
        n += 1
        now = {a for a, b, _, _ in calls if b in now} - set(depth)
        depth |= dict.fromkeys(now, n)
    assert Counter(pairs(all_callers(graph(spark, SF), target, n=None), "line_number", "depth")) == Counter(depth.items())
