"""Tables written to the folder all executors share, to cut lineage and to compute a costly pass once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.session import shared_folder

#: A join side of at most this many narrow rows (ids and numbers) may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


#: Rows that scans read at once, where rows are wide.
FEW_ROWS, BATCH_ROWS = 256, "spark.sql.parquet.columnarReaderBatchSize"
#: Whether shuffle files of a query go when it ends, not when the driver comes to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, compression: str = "snappy", row_group: int = 128 << 20, wide: bool = False) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back. row_group: bytes that writers, and readers of a column, hold.
    wide: the scans that df begins with read FEW_ROWS at once. Nothing that df shuffled stays on disk beside the table."""
    path, conf = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    usual, freed = conf.get(BATCH_ROWS), conf.get(FREED, "false")
    try:
        conf.set(FREED, "true")
        if wide:
            conf.set(BATCH_ROWS, FEW_ROWS)
        df.write.option("parquet.block.size", row_group).parquet(path, compression=compression)
    finally:
        conf.set(BATCH_ROWS, usual)
        conf.set(FREED, freed)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def narrow(ids: DataFrame) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast if its counted size is within BROADCAST_ROWS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def veiled(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1 and so on, which clash with no column of an operator, and what they stand for: {name: c...}."""
    names = {n: f"c{i}" for i, n in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unveiled(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns that veiled() renamed, by their own names."""
    return df.select(*[F.col(c).alias(n) for n, c in names.items()])
