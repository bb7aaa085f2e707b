import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from srcgraph.session import ship

    ship(s)
    yield s


@pytest.fixture(scope="session")
def repo(spark, tmp_path_factory):
    from srcgraph.graph import PropertyGraph
    from srcgraph.operators.resolve import index_repository
    from srcgraph.sources.files import scan

    root, path = os.path.join(ROOT, "tests/fixtures/repo"), str(tmp_path_factory.mktemp("graph"))
    index_repository(scan(spark, root).coalesce(1), root, "sample").write(path)
    return PropertyGraph.read(spark, path)
