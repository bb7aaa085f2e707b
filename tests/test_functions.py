"""Scalar expressions, ignore rules, debouncing and the registry, on small rows."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from srcgraph.functions import text
from srcgraph.operators import registry
from srcgraph.sources.files import pattern_lines, pattern_regex
from srcgraph.streaming.watch import debounced, mapped


@pytest.mark.parametrize(
    ("patterns", "path", "ignored"),
    [
        (["*.png"], "a/b.png", True), (["*.png"], "a/b.py", False), (["build/"], "build/x.py", True), (["build/"], "src/build/x.py", True), (["build/"], "build", False), (["/build/"], "src/build/x.py", False),
        (["a/**/z.py"], "a/b/c/z.py", True), (["a/**/z.py"], "a/z.py", True), (["docs/**"], "docs/a/b", True), (["*.py", "!keep.py"], "keep.py", False), (["*.py", "!keep.py"], "x.py", True), (["te?t.rs"], "test.rs", True), (["[ab].py"], "c.py", False), (["[!ab].py"], "c.py", True),
    ],
)
def test_ignore_patterns(patterns, path, ignored):
    out = False
    for p in patterns:
        regex, back = pattern_regex(p)
        if re.search(regex, path):
            out = not back
    assert out is ignored


def test_pattern_lines():
    assert pattern_lines("# a\n\nvenv/\n *.x  \n") == ["venv/", " *.x"]


def test_scalars(spark):
    df = spark.createDataFrame([("@login_required", "a/b/c.py"), ("@app.route('/users')", "a/b.rs"), ("staticmethod", "x")], "d string, p string")
    got = df.select(text.normalised_decorator(F.col("d")), text.stem(F.col("p")), text.parent(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("login_required", "c", "a/b"), ("app.route", "b", "a"), ("staticmethod", "x", "")]


def test_debounce_and_registry(spark):
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([(t, "created", "a.py"), (t + timedelta(seconds=1), "renamed", "a.py"), (t + timedelta(seconds=9), "removed", "a.py"), (t, "modified", "b.txt"), (t, "other", "c.py")], "ts timestamp, kind string, path string")
    assert sorted((r["n_events"], r["action"]) for r in debounced(mapped(events)).collect()) == [(1, "removed"), (2, "modified")]
    bundles = spark.createDataFrame([("n", "n-1", "r", "2024"), ("n", "n-2", "r", "2025"), ("m", "m-1", "q", "2023")], "name string, full_name string, repo string, generated_at string")
    assert [r["full_name"] for r in registry.search(bundles, "N", True).collect()] == ["n-2"]
    assert registry.find(bundles, "n-1").first()["full_name"] == "n-1" and registry.find(bundles, "n").first()["full_name"] == "n-2"
