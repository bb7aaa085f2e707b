"""Incremental relinking against a graph built anew, and the streaming query that drives it."""

import os
import time

import pytest
from pyspark.sql import functions as F

from srcgraph.operators.resolve import index_repository
from srcgraph.sources.files import scan
from srcgraph.streaming import watch

BEFORE = {
    "app.py": "from pkg.util import helper\nfrom pkg.base import Base\n\n\nclass App(Base):\n    def go(self):\n        return helper(1)\n\n\ndef main():\n    return App().go()\n",
    "pkg/util.py": "def helper(x):\n    return other(x)\n\n\ndef other(x):\n    return x\n",
    "pkg/base.py": "class Base:\n    def stop(self):\n        return 0\n",
    "pkg/old.py": "def gone():\n    return 1\n",
    "far.py": "def alone():\n    return near()\n\n\ndef near():\n    return 2\n",
}
AFTER = {"pkg/util.py": "def added():\n    return main()\n\n\ndef helper(x):\n    return added()\n", "pkg/old.py": None, "new.py": "from pkg.util import helper\n\n\ndef fresh():\n    return helper(2)\n"}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text) if text is not None else path.unlink()


def edges(g):
    return {k: sorted(tuple(r) for r in g.edge(k).select("src", "dst").distinct().collect()) for k in ("CALLS", "INHERITS", "CONTAINS", "IMPORTS")}


def reader(spark, root):
    return lambda paths: scan(spark, str(root)).join(paths, "path", "left_semi")


@pytest.fixture
def root(tmp_path):
    write(tmp_path / "r", BEFORE)
    return tmp_path / "r"


def test_relinking_equals_indexing_anew(spark, root):
    old = index_repository(scan(spark, str(root)), str(root), "r")
    old.write(str(root.parent / "stored"))
    old = type(old).read(spark, str(root.parent / "stored"))
    before = watch.listing(spark, str(root)).toPandas()
    time.sleep(0.05)
    write(root, AFTER)
    events = watch.events_between(spark.createDataFrame(before), watch.listing(spark, str(root)))
    changed = events.select("path", F.col("kind").alias("action"))
    assert {(os.path.relpath(r["path"], root), r["action"]) for r in changed.collect()} == {("pkg/util.py", "modified"), ("pkg/old.py", "removed"), ("new.py", "created")}
    new = watch.relinked(old, changed, reader(spark, root), str(root))
    whole = index_repository(scan(spark, str(root)), str(root), "r")
    assert edges(new) == edges(whole)
    for label in ("Function", "Class", "File", "Repository"):
        assert {r["id"] for r in new.node(label).collect()} == {r["id"] for r in whole.node(label).collect()}
    again = watch.relinked(new, changed, reader(spark, root), str(root))
    assert edges(again) == edges(whole)


def test_watch_hands_over_closed_bursts(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "created", "/r/a.py"), ("2024-01-01 00:00:01", "modified", "/r/a.py"), ("2024-01-01 00:00:01", "modified", "/r/b.txt"), ("2024-01-01 00:00:09", "renamed", "/r/a.py"), ("2024-01-01 01:00:00", "created", "/r/end.py")]
    source = tmp_path / "events"
    spark.createDataFrame(rows, "ts string, kind string, path string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(source))
    seen = []
    stream = spark.readStream.schema("ts timestamp, kind string, path string").parquet(str(source))
    query = watch.watch(stream, lambda batch, i: seen.extend(tuple(r) for r in batch.collect()), str(tmp_path / "checkpoint"), name="r")
    assert watch.watched(spark) == ["watch_r"]
    query.processAllAvailable()
    assert watch.unwatch(spark, "r") and not watch.unwatch(spark, "r")
    assert seen == [("/r/a.py", "modified")]


def test_initial_scan_keeps_what_is_stored(spark, root, repo):
    at = repo.node("Repository").first()["path"]
    assert watch.initial_scan(spark, at, repo) is repo
    assert watch.initial_scan(spark, str(root), repo).node("Function").where("name = 'main'").count() == 1
