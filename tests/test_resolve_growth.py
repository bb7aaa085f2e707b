"""Calls are resolved once for each file and name, and moved once."""

import re

import pytest

from srcgraph.operators import resolve, traverse

SF = "/root/testdata/sf0.001"


def test_calls_are_joined_once(spark):
    from srcgraph.plans.catalogue import parse_rows

    df = resolve.resolve_calls(traverse.cut(parse_rows(spark, SF)))
    assert len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString())) == 1


@pytest.mark.parametrize("crowd", [1, 40])
def test_first_place_of_any_import(spark, crowd):
    """Few names in an imported place, and more than the file asks for: both ways find the first path."""
    index = [(n, f"/r/{d}/{f}.py", "python") for d in "ab" for f in "xy" for n in ["one", "two"] + [f"n{i}" for i in range(crowd)]]
    wanted = [("/r/u.py", "python", "one"), ("/r/u.py", "python", "none"), ("/r/v.py", "python", "two"), ("/r/w.py", "python", "one"), *(("/r/all.py", "python", f"n{i}") for i in range(crowd))]
    imports = [("/r/u.py", "b.y.one"), ("/r/u.py", "b"), ("/r/v.py", "a.y"), ("/r/w.py", "other.one"), ("/r/all.py", "b.z")]
    got = resolve.through_any(spark.createDataFrame(wanted, "path string, lang string, name string"), spark.createDataFrame(imports, "path string, full_name string"), spark.createDataFrame(index, "name string, path string, lang string"))
    assert {tuple(r) for r in got.select("path", "name", "rescued").collect()} == {("/r/u.py", "one", "/r/b/x.py"), ("/r/v.py", "two", "/r/a/x.py")} | {("/r/all.py", f"n{i}", "/r/b/x.py") for i in range(crowd)}
