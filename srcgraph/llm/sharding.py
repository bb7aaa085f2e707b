"""Sharding by weighted rendezvous hashing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import hex_key, running, unit
from .staging import read, veiled

SHARDS = 16


def rendezvous(key: Column, weights: tuple[float, ...]) -> Column:
    """The shard of a key: the least -ln(u)/weight, u a uniform hash of key and shard; ties go to the lower shard.

    A further shard takes over only the keys on which it wins, and each shard holds keys in proportion to its weight.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    costs = [F.struct((-F.log(unit(F.md5(F.concat(text, F.lit(f":{s}"))))) / F.lit(float(w))).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return costs[0]["s"] if len(costs) == 1 else F.array_min(F.array(*costs))["s"]


NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, weights: tuple[float, ...] = (1.0,) * SHARDS, grown: float = 1.0, key: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard if one more of weight `grown` existed).

    A null key counts as the empty key; a null text has size 1 and the CRC of no bytes. Repeated rows share a shard and have
    slots of their own, as have equal keys, in the order of CRC and size. A very long text is read whole. No documents, no rows.
    Columns of docs by the names of new ones are replaced; all others stay. Weights must be above 0.
    """
    if not weights or min(*weights, grown) <= 0:
        raise ValueError("weights of shards must be above 0")
    x, names = veiled(docs.drop(*NEW))
    own, text = F.col(names[key]), F.coalesce(F.col(names["text"]), F.lit(""))
    x = x.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "law": F.lit("key"), "shard": rendezvous(own, weights), "grown_shard": rendezvous(own, (*weights, grown)), "order": hex_key(own)})
    x = running(x, ["shard"], "order", [names[key], "text_crc32", "size"], F.lit(1), docs.count(), "slot")
    return x.select(*[F.col(c).alias(n) for n, c in names.items()], *NEW)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _winner(shards: int) -> str:
    return f"(list_sort(list_transform(range({shards}), lambda s: {{'c': -ln((('0x' || substr(md5(k || ':' || s), 1, 12))::BIGINT + 0.5) / 281474976710656.0), 's': s}}))[1]).s::INTEGER"


ORACLE_SQL = f"""
WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
bytes AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
x AS (SELECT doc_id, k, t, {_winner(SHARDS)} AS shard, {_winner(SHARDS + 1)} AS grown_shard FROM bytes)
SELECT doc_id, (strlen(t) + 1)::BIGINT AS size,
  xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, list_extract(tab, (xor(c, b) & 255) + 1))), 4294967295)::BIGINT AS text_crc32,
  'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id) - 1)::BIGINT AS slot, grown_shard
FROM x, poly
"""
