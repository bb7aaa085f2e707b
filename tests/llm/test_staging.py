"""What staged tables leave on disk."""

import time

from pyspark.sql import functions as F

from srcgraph.llm.staging import drop, stage


def shuffled(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_shuffle_files_go_when_a_table_is_staged(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, usual = shuffled(spark), spark.conf.get(name, "false")
    df = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))
    out = stage(df, "shuffled")
    for _ in range(20):
        if shuffled(spark) <= before:
            break
        time.sleep(0.25)
    assert shuffled(spark) <= before and spark.conf.get(name, "false") == usual
    assert out.count() == df.count() == 1000 and out.agg(F.sum("s")).first()[0] == 100_000 * 99_999 // 2
    drop(out)
