"""Running sums within groups of any size, without a task that holds a whole group.

A group is cut into buckets along a uniform hash of its order, each bucket is summed in one
window, and the sums of earlier buckets are added. Native DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a bucket of the largest possible group should hold.
BUCKET_ROWS = 20_000


def hex_key(*cols: Column) -> Column:
    """A stable uniform order of records: md5 of their key's text, as hex digits."""
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def unit(key: Column) -> Column:
    """The first 48 bits of a hex key as a number in (0, 1)."""
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def running(df: DataFrame, group: list[str], key: str, ties: list[str], value: Column, rows: int, out: str) -> DataFrame:
    """df with a long column out: the sum of value over the rows of the group that come earlier by (key, ties).

    group: columns without nulls. key: a column of hex_key. rows: the count of df, from which the number of buckets follows.
    """
    n = max(16, -(-rows // BUCKET_ROWS))
    df = df.withColumns({"_v": value.cast("long"), "_b": F.floor(unit(F.col(key)) * n).cast("int")})
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    sums = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_from"))
    inner = W.partitionBy(*group, "_b").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return df.join(sums, [*group, "_b"]).withColumn(out, F.col("_from") + F.col("_in")).drop("_v", "_b", "_in", "_from")
