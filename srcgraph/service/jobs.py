"""Background jobs as a table of events; the state of a job is its latest event."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.text import elapsed

#: States, and those in which a job is under way.
STATES = ("pending", "running", "completed", "failed", "cancelled")
ACTIVE = ("pending", "running")
#: Seconds that a file takes to index, for estimates.
SECONDS_A_FILE = 0.05
EVENT = "job_id string, seq long, at double, state string, path string, is_dependency boolean, total_files long, processed_files long, current_file string, error string"


class JobLog:
    """Events appended as small JSON files to a folder; readers need no lock, writers of one process take turns."""

    def __init__(self, spark: SparkSession, folder: str, workers: int = 4, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock
        self.lock, self.seq, self.pool = threading.Lock(), 0, ThreadPoolExecutor(workers)

    def tell(self, job_id: str, state: str, path: str | None = None, is_dependency: bool = False, total: int | None = None, done: int | None = None, current: str | None = None, error: str | None = None) -> None:
        if state not in STATES:
            raise ValueError(f"unknown state {state!r}")
        with self.lock:
            self.seq = max(self.seq + 1, int(self.clock() * 1e6))
            row = (job_id, self.seq, float(self.clock()), state, path, is_dependency, total, done, current, error)
            self.spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").json(self.folder)

    def events(self) -> DataFrame:
        with self.lock:
            if not self.seq and not self._exists():
                return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).json(self.folder)

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def jobs(self) -> DataFrame:
        """A row for each job: its state, path, progress in percent, seconds so far and, while it runs, seconds left; the newest start first."""
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        j = self.events().groupBy("job_id").agg(F.min("at").alias("started"), F.max("at").alias("told"), *[last(c) for c in ("state", "path", "is_dependency", "total_files", "processed_files", "current_file")], F.array_sort(F.collect_set("error")).alias("errors"))
        share = F.when(F.col("total_files") > 0, F.coalesce("processed_files", F.lit(0)) / F.col("total_files")).otherwise(0.0)
        ended = ~F.col("state").isin(*ACTIVE)
        spent = F.when(ended, F.col("told")).otherwise(F.lit(float(self.clock()))) - F.col("started")
        left = F.when((F.col("state") == "running") & (F.col("processed_files") > 0), spent / F.col("processed_files") * (F.col("total_files") - F.col("processed_files")))
        j = j.withColumns({"progress": share * 100, "seconds": spent, "seconds_left": left, "ended": F.when(ended, F.col("told"))})
        return j.withColumn("took", elapsed(F.col("seconds"))).orderBy(F.desc("started"), "job_id")

    def status(self, job_id: str) -> DataFrame:
        return self.jobs().where(F.col("job_id") == job_id)

    def active(self, path: str) -> DataFrame:
        """The latest job of a path that is under way, if there is one."""
        return self.jobs().where((F.col("path") == path.rstrip("/")) & F.col("state").isin(*ACTIVE)).limit(1)

    def purge(self, hours: float = 24) -> int:
        """Takes jobs out of the log that ended so long ago; how many."""
        old = self.jobs().where(F.col("ended") < self.clock() - hours * 3600).select("job_id")
        ids = [r[0] for r in old.collect()]  # jobs of one session, not data
        if ids:
            with self.lock:
                kept = self.spark.createDataFrame(self.spark.read.schema(EVENT).json(self.folder).where(~F.col("job_id").isin(ids)).collect(), EVENT)
                kept.coalesce(1).write.mode("overwrite").json(self.folder)
        return len(ids)

    def start(self, path: str, work: Callable[[Callable[..., None]], object], is_dependency: bool = False, total: int | None = None) -> str:
        """Runs work(progress) in the background and logs how it goes; the job's id. A path with a job under way is refused."""
        path = path.rstrip("/")
        if not self.active(path).isEmpty():
            raise ValueError(f"a job for {path} is under way")
        job_id = str(uuid.uuid4())
        self.tell(job_id, "pending", path, is_dependency, total)

        def run() -> object:
            self.tell(job_id, "running", done=0)
            try:
                result = work(lambda done, current=None: self.tell(job_id, "running", done=done, current=current))
            except Exception as e:
                self.tell(job_id, "failed", error=f"{type(e).__name__}: {e}"[:500])
                return None
            self.tell(job_id, "completed", done=total)
            return result

        self.pool.submit(run)
        return job_id

    def close(self) -> None:
        """Waits for the jobs under way."""
        self.pool.shutdown(wait=True)


def estimate(spark: SparkSession, root: str) -> tuple[int, float]:
    """How many files of a folder would be indexed, and the seconds that may take. Names decide; contents are not read."""
    from srcgraph.sources.files import scan

    n = scan(spark, root).select("path").count()
    return n, n * SECONDS_A_FILE
