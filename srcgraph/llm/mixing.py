"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.session import settle

from .numbering import hex_key, running
from .staging import drop, read, stage, unveiled, veiled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: For each weight the slope k of its schedule: at time t from 0 to 1 the density is 1 + k - 2kt, so 0.5 falls from 1.5 to 0.5.
TILTS = (0.5, 0.0, -0.5)
MOST = 3


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source (_null, _src): source_size, target, tilt.

    Sources by code point, null last, have the weights in turn; a target stops at `most` times its source's size, and the
    excess goes to the others by weight. With the sources in order of most * size / weight, source j is at its stop if its
    share of what is left after the earlier ones' stops exceeds it; the first that is not fixes the level for the rest.
    The windows here see one row a source.
    """
    s = sizes.groupBy("_null", "_src").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy("_null", "_src")) - 1) % len(weights)
    s = s.withColumn("_turn", turn).withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_turn") + 1).cast("int")))
    s = s.withColumn("_stop", F.col("source_size") * most).withColumn("_total", F.sum("source_size").over(W.partitionBy()))
    order = W.orderBy(F.col("_stop") / F.col("_w"), "_null", "_src")
    s = s.withColumns({"_left": F.col("_total") - F.coalesce(F.sum("_stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_rest": F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)), "_n": F.row_number().over(order)})
    s = s.withColumn("_level", F.when(F.col("_stop") * F.col("_rest") >= F.col("_left") * F.col("_w"), F.struct("_n", (F.col("_left") / F.col("_rest")).alias("v"))))
    s = s.withColumn("_level", F.min("_level").over(W.partitionBy()))
    full = F.col("_n") < F.col("_level._n")
    tilt = F.element_at(F.array(*[F.lit(float(k)) for k in TILTS]), (F.col("_turn") % len(TILTS) + 1).cast("int"))
    return s.select("_null", "_src", "source_size", F.when(full, F.col("_stop").cast("double")).otherwise(F.col("_level.v") * F.col("_w")).alias("target"), tilt.alias("tilt"))


def when_due(demand: Column, target: Column, tilt: Column) -> Column:
    """The time t in [0, 1] at which the integral (1 + k)t - kt^2 of the schedule has used up demand/target."""
    y = demand / target
    root = F.sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * y)
    return F.when(tilt == 0, y).otherwise((1 + tilt - root) / (2 * tilt))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, each_pass: bool = False) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, position.

    A source is a stream of its documents in the order of a hash of doc_id, gone through up to `most` times until the
    target is used up, so its takes add up to the whole part of its target; the last one may be cut. position: the time
    at which the first pass of the document is due, null if nothing of it is taken. Null or empty texts have size 0 and
    nothing taken; a null source is a source. Rows come in the order of position. Repeated rows count as documents.
    each_pass: docs have a _mark, which is kept, and positions tell the time at which each pass is due, null for those not taken.
    """
    sizes = docs.select("doc_id", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hex_key(F.col("doc_id")).alias("_key"), *["_mark"] * each_pass)
    sizes = stage(sizes, "mix-sizes")
    x = running(sizes, ["_null", "_src"], "_key", ["doc_id", "size", *["_mark"] * each_pass], F.col("size"), sizes.count(), "_before")
    x = x.join(targets(sizes, weights, most), ["_null", "_src"])
    quota = F.floor("target")
    passes = [F.greatest(F.lit(0), F.least(quota - F.col("source_size") * p - F.col("_before"), F.col("size"))) for p in range(most)]
    x = x.withColumn("taken", sum(passes[1:], passes[0]).cast("long"))
    x = x.withColumn("position", F.when(F.col("taken") > 0, when_due(F.col("_before").cast("double"), F.col("target"), F.col("tilt"))))
    if each_pass:
        due = [F.when(n > 0, when_due((F.col("_before") + F.col("source_size") * p).cast("double"), F.col("target"), F.col("tilt"))) for p, n in enumerate(passes)]
        x = x.withColumn("positions", F.array(*due))
    x = stage(x.select("doc_id", "size", "source_size", "target", "taken", "position", "_key", *["_mark", "positions"] * each_pass), "mix-taken")
    drop(sizes)
    return x


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mix(read(spark, sf_dir, "documents"))
    x = x.withColumn("_at", F.coalesce("position", F.lit(2.0)))
    return x.repartitionByRange("_at", "_key").sortWithinPartitions("_at", "_key").drop("_at", "_key")


def mix_stage(docs: DataFrame) -> DataFrame:
    """docs as the mix reads them: each as often as its words are taken (to whole documents), each pass at its own position.

    Rows are told apart by all their columns; rows equal in all take their passes together. Texts without words are not taken.
    No documents, no rows; the columns are those of docs.
    """
    settle(docs.sparkSession)  # what earlier stages shuffled can go before whole texts are moved here
    x, names = veiled(docs)
    # a doc_id may be null or that of other rows too, so a hash of the whole row decides with it
    x = x.withColumn("_mark", F.xxhash64(*names.values(), *[F.col(c).isNull() for c in names.values()]))
    own = x.select(*[F.col(names[n]).alias(n) for n in ("doc_id", "source", "text")], "_mark")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    taken = mix(own, each_pass=True).select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_row"), F.col("_key").alias("_order"), F.slice("positions", F.lit(1), times).alias("_takes"))
    taken = taken.groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("_n"), F.flatten(F.collect_list("_takes")).alias("_takes"), F.first("_order").alias("_order")).where("size(_takes) > 0")
    x = x.join(taken, x[names["doc_id"]].eqNullSafe(taken["_id"]) & (x["_mark"] == taken["_row"]))
    # rows equal in all columns take their passes together
    x = x.where("_n = 1").unionByName(x.where("_n > 1").dropDuplicates(["_id", "_row"]))
    x = x.withColumn("_at", F.explode("_takes"))
    return unveiled(x.repartitionByRange("_at", "_order", "_row").sortWithinPartitions("_at", "_order", "_row"), names)


ORACLE_SQL = r"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
  ([0.5, 0.0, -0.5]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS tilt FROM z GROUP BY source),
o AS (SELECT *, row_number() OVER q AS n, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
  (sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM s WINDOW q AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
l AS (SELECT n AS at_n, lft / rest AS v FROM o WHERE 3 * source_size * rest >= lft * w ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, tilt, CASE WHEN n < at_n THEN (3 * source_size)::DOUBLE ELSE v * w END AS target FROM o, l),
d AS (SELECT z.*, source_size, target, tilt, (sum(size) OVER (PARTITION BY z.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS b
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (greatest(0, least(floor(target)::BIGINT - b, size)) + greatest(0, least(floor(target)::BIGINT - source_size - b, size)) + greatest(0, least(floor(target)::BIGINT - 2 * source_size - b, size)))::BIGINT AS taken FROM d)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN b / target ELSE (1 + tilt - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * (b / target))) / (2 * tilt) END END AS position FROM e
"""
