"""What a session needs so that Python workers find this package."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864", "4194304"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Adds the folder of this package to the workers' path; on a cluster the package is installed or sent at the same place.

    Batches between Spark and its workers are kept to BATCH_BYTES, unless the session says otherwise: rows of long texts make large ones.
    """
    if spark.conf.get(BATCH_CONF, DEFAULT_BATCH) in (DEFAULT_BATCH, f"{DEFAULT_BATCH}b", "64MB", "64m"):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # gives memory back between batches
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "1000000")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local folder serves a local master, as in tests; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/srcgraph-checkpoints"


def settle(spark: SparkSession) -> None:
    """Gives back the driver's memory that models and long chains of plans leave behind: Python's, and the JVM's with its compiled plans.

    Collecting there also lets Spark delete the shuffle files of plans that are gone.
    """
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass
    spark._jvm.System.gc()


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
