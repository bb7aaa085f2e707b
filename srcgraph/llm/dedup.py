"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Senders (pieces of input partitions) send each owner of a fingerprint range their sorted fingerprints, as Golomb-Rice
coded gaps. Owners answer each sender with a bitmap of those that others hold too. Only texts so suspected are moved and
compared, byte by byte, as grouping keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import drop, narrow, read, stage, unveiled, veiled

BLANKS = b" \t\n\x0b\x0c\r"
#: Rows that a sender holds at once; a larger partition is several senders.
SENDER_ROWS = 200_000


def rice(gaps: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of non-negative integers: the quotient by 2^k in unary, then k bits."""
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - k - 1
    ones = np.ones(len(bits), np.int8)
    ones[at] = 0
    for j in range(k):
        ones[at + 1 + j] = (gaps >> np.uint64(k - 1 - j)).astype(np.int8) & 1
    bits[:] = ones
    return np.packbits(bits).tobytes()


def unrice(code: bytes, n: int, k: int) -> np.ndarray:
    """The n integers of rice()."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    if k == 0:
        heads = np.flatnonzero(bits == 0)[:n]
        return np.diff(heads, prepend=-1).astype(np.uint64) - np.uint64(1)
    # an integer that starts at bit i ends k bits behind the first zero from i on: follow these steps in jumps of doubling length
    zero = np.flatnonzero(bits == 0)
    after = np.full(len(bits) + 1, len(bits), np.int64)
    after[: len(bits)] = np.append(zero, len(bits))[np.searchsorted(zero, np.arange(len(bits)))]
    step = np.minimum(after + 1 + k, len(bits))
    starts = np.zeros(1, np.int64)
    while len(starts) < n:
        starts = np.concatenate([starts, step[starts]])  # starts holds the first 2^j of them, step leads 2^j on
        step = step[step]
    heads = after[starts[:n]]
    out = (heads - starts[:n]).astype(np.uint64)
    for j in range(k):
        out = (out << np.uint64(1)) | bits[heads + 1 + j]
    return out


def digests(docs: DataFrame, owners: int) -> DataFrame:
    """A row for each document (kind 0) and for each sender and owner (kind 1: the code of the sender's fingerprints there)."""

    def send(batches):
        part, count = TaskContext.get().partitionId(), 0
        ids, points, shas = [], [], []

        def flush(sender):
            prints = np.array([int.from_bytes(s[:8], "big") for s in shas], np.uint64)
            keys, which, times = np.unique(prints, return_inverse=True, return_counts=True)
            owner = ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(owner, np.arange(owners + 1))
            which = which.ravel()
            own = owner[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(points, pa.int64()), pa.array([s.hex() for s in shas], pa.string()), pa.array(np.full(len(ids), sender)), pa.array(own), pa.array(which - edges[own]), pa.array(times[which] > 1), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.int32())], names=names
            )
            full = np.flatnonzero(np.diff(edges))
            codes, shifts = [], []
            for o in full:
                gaps = np.diff(keys[edges[o] : edges[o + 1]], prepend=np.uint64(-(-(int(o) << 64) // owners)) if o else np.uint64(0))
                k = max(0, int(np.log2(max(1.0, float(gaps.astype(float).mean())))))
                codes.append(rice(gaps, k))
                shifts.append(k)
            m = len(full)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array(np.full(m, sender)), pa.array(full.astype(np.int64)), pa.array(np.diff(edges)[full].astype(np.int64)), pa.nulls(m, pa.bool_()), pa.array(codes, pa.binary()), pa.array(shifts, pa.int32())], names=names)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                ids.append(i)
                points.append(len(t))
                shas.append(hashlib.sha256(t.encode("utf-8", "surrogatepass").translate(None, BLANKS)).digest())
            if len(ids) >= SENDER_ROWS:
                yield from flush(np.int64(part << 20 | count))
                count += 1
                ids, points, shas = [], [], []
        if ids:
            yield from flush(np.int64(part << 20 | count))

    names = ["kind", "doc_id", "points", "sha", "sender", "owner", "place", "local", "code", "shift"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, "kind int, doc_id long, points long, sha string, sender long, owner long, place long, local boolean, code binary, shift int")


def answers(rows: DataFrame, owners: int) -> DataFrame:
    """For each sender and owner a bitmap by place: 1 if another sender has the fingerprint too."""

    def answer(t: pa.Table) -> pa.Table:
        o = t.column("owner")[0].as_py()
        base = np.uint64(-(-(o << 64) // owners)) if o else np.uint64(0)
        keys = [base + np.cumsum(unrice(c, n, k)) for c, n, k in zip(t.column("code").to_pylist(), t.column("place").to_pylist(), t.column("shift").to_pylist())]
        found, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        twice = (times > 1)[which.ravel()]
        parts = np.split(twice, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"sender": t.column("sender"), "owner": t.column("owner"), "bitmap": pa.array([np.packbits(p, bitorder="little").tobytes() for p in parts], pa.binary())})

    return rows.where("kind = 1").select("owner", "sender", "place", "code", "shift").groupBy("owner").applyInArrow(answer, "sender long, owner long, bitmap binary")


def bare(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without [\\x20\\x09-\\x0D]; null counts as empty. The one with the most code points, then
    the smallest doc_id, stays; a null doc_id comes after all others. Rows that repeat a doc_id with an equal text are copies that
    share keep_id and `kept`. A very long text is hashed whole. No documents, no rows. Other columns of docs are not read.
    """
    owners = max(4, docs.rdd.getNumPartitions())
    rows = stage(digests(docs, owners), "dedup-digests")
    own = rows.where("kind = 0").select("doc_id", "points", "sha", "sender", "owner", "place", "local")
    maps = answers(rows, owners)
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(place % 8 as int)) & 1") == 1
    marked = own.join(maps, ["sender", "owner"]).withColumn("_byte", byte).withColumn("suspect", F.col("local") | hit)
    marked = stage(marked.select("doc_id", "points", "sha", "suspect"), "dedup-marked")
    suspects = marked.where("suspect").select("doc_id", "points", "sha")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bare(F.col("text")).alias("bare"))
    ids = stage(suspects.select("doc_id").distinct(), "dedup-suspects")
    texts = texts.join(narrow(ids), texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    # the bytes themselves are the key; map sides have already summed them up before they are moved
    same = texts.groupBy("bare").agg(F.count(F.lit(1)).alias("group_size")).select(F.sha2("bare", 256).alias("sha"), "group_size")
    rank = F.struct((-F.col("points")).alias("longest"), F.col("doc_id").isNull().alias("none"), "doc_id")
    best = suspects.groupBy("sha").agg(F.min(rank)["doc_id"].alias("keep_id"))  # an aggregate, so hot groups are combined before they are moved
    groups = stage(same.join(best, "sha"), "dedup-groups")
    doubled = suspects.join(groups, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    single = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    drop(rows)
    return single.unionByName(doubled)


def op8_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """docs without the copies that exact_dedup drops: of equal texts one row stays, the longest, then the one of the least doc_id.

    Rows are told apart by doc_id, null included, and text, so a number that other texts have too loses none of them. Null and
    empty texts are equal. Of rows with one doc_id and text one stays. No documents, no rows; the columns are those of docs.
    """
    found = stage(exact_dedup(docs), "dedup-found")
    x, names = veiled(docs)
    own_id, text = names["doc_id"], names["text"]
    # a doc_id may be null or that of other texts too, so it decides together with the digest
    doubled = found.where("group_size > 1").select(F.col("doc_id").alias("id"), F.substring("text_sha256", 1, 32).alias("mark"), "kept")
    pairs = doubled.groupBy("id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    pairs = stage(pairs.select("id", "mark", "kept"), "dedup-pairs")
    drop(found)
    x = x.withColumn("own", F.substring(F.sha2(bare(F.col(text)), 256), 1, 32))
    x = x.join(narrow(pairs), x[own_id].cast("long").eqNullSafe(pairs["id"]) & (x["own"] == pairs["mark"]), "left")
    alone = unveiled(x.where("kept is null"), names)
    best = F.max_by(F.struct(*names.values()), F.struct(F.length(text), text))
    once = x.where("kept").groupBy("id", "mark").agg(best.alias("best")).select("best.*")
    return alone.unionByName(unveiled(once, names))


ORACLE_SQL = r"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY b ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY b ORDER BY length(t) DESC, doc_id) AS kept, sha256(b) AS text_sha256 FROM x
"""
