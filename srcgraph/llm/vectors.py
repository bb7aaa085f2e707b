"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A hash of a vector is the axis its rotation points to most, with its sign. A table joins HASHES of them to a code. Each
vector stands in the bucket of its code and, as a probe, in those of its next best codes; two vectors meet where one of them
stands and the other stands or probes. All meetings are verified in double precision, in tiles of bounded size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .staging import drop, read, stage

COSINE = 0.98
#: Probes of a vector in each table; vectors of a label that should share a bucket if all were unlike.
PROBES, BUCKET = 2, 8
#: Members of a block, and rows that one call compares.
BLOCK, CALL_ROWS = 1000, 50_000
SEED = 42


def plan(largest: int, width: int) -> tuple[int, int]:
    """(hashes of a table, tables) for a label of `largest` vectors: more hashes keep buckets small, more tables the recall.

    With two probes a pair of cosine 0.98 in 64 dimensions meets in a table of 1, 2 or 3 hashes with probability 0.98, 0.89 or 0.76, and in
    4, 6 or 8 tables all but 1 in 100,000 of such pairs meet; closer pairs meet more often.
    """
    hashes = min(6, max(1, math.ceil(math.log(max(largest, 1) / BUCKET, 2 * width)))) if largest > BUCKET else 1
    return hashes, 2 + 2 * hashes


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; x: rows of a power of two of numbers."""
    n = x.shape[1]
    signs = np.random.default_rng((SEED, seed, n)).choice([-1.0, 1.0], (3, n))
    for s in signs:
        x, h = x * s, 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
            h *= 2
        x = x / math.sqrt(n)
    return x


def codes(x: np.ndarray, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, tables) and probes (rows, tables, PROBES) of unit vectors."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    base, probes = [], []
    top = min(width, 4)
    for t in range(tables):
        code, others, gaps = np.zeros(len(x), np.int64), [], []
        for j in range(hashes):
            r = rotated(x, t * 64 + j)
            size = np.abs(r)
            axes = np.argpartition(-size, top - 1, 1)[:, :top]
            axes = np.take_along_axis(axes, np.argsort(-np.take_along_axis(size, axes, 1), 1, kind="stable"), 1)
            sign = np.take_along_axis(r, axes, 1) > 0
            size = np.take_along_axis(size, axes, 1)
            own = (axes * 2 + sign).astype(np.int64)
            unit = (2 * width) ** j
            code += own[:, 0] * unit
            for k in range(1, top):
                others.append((own[:, k] - own[:, 0]) * unit)
                gaps.append((size[:, 0] - size[:, k]) ** 2)
        near = np.argsort(np.array(gaps).T, 1, kind="stable")[:, :PROBES]
        near = np.take_along_axis(np.array(others).T, near, 1) + code[:, None]
        if near.shape[1] < PROBES:
            near = np.concatenate([near, np.full((len(x), PROBES - near.shape[1]), -1)], 1)
        base.append(code)
        probes.append(near)
    return np.stack(base, 1), np.stack(probes, 1)


def valid(vector) -> np.ndarray | None:
    """A vector as float64, or None if it links with nothing."""
    if vector is None or not len(vector) or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    return x if np.isfinite(x).all() and np.abs(x).max() > 0 else None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def named(vectors: DataFrame) -> DataFrame:
    """vec_id, label, node (64 bits of a digest of label and vector; null if it links with nothing) and the vector's float64 bytes."""

    def look(batches):
        for b in batches:
            nodes, data = [], []
            for label, vector in zip(b.column("label").to_pylist(), b.column("embedding").to_pylist()):
                x = valid(vector) if label is not None else None
                data.append(None if x is None else x.tobytes())
                nodes.append(None if x is None else int.from_bytes(hashlib.blake2b(data[-1] + str(label).encode(), digest_size=8).digest(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], names=["vec_id", "label", "node", "data"])

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return picked.mapInArrow(look, "vec_id long, label string, node long, data binary")


def hashed(reps: DataFrame, hashes: int, tables: int) -> DataFrame:
    """reps (node, label, copies, data) with base and probe codes as bytes."""

    def look(batches):
        for b in batches:
            data = b.column("data").to_pylist()
            base, probe = [None] * len(data), [None] * len(data)
            sizes = np.array([len(d) for d in data])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = unit(np.frombuffer(b"".join(data[i] for i in own), np.float64).reshape(len(own), -1))
                for i, p, q in zip(own.tolist(), *codes(x, hashes, tables)):
                    base[i], probe[i] = p.tobytes(), q.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, pa.binary()), pa.array(probe, pa.binary())], names=[*b.schema.names, "base", "probe"])

    return reps.select("node", "label", "copies", "data").mapInArrow(look, "node long, label string, copies long, data binary, base binary, probe binary")


def stands(reps: DataFrame) -> DataFrame:
    """(bucket, at, side, node): where each vector stands (side 0) or probes (1). at: its table and code, so as to tell buckets apart."""

    def look(batches):
        for b in batches:
            rows = [[], [], [], []]
            for node, label, data, base, probe in zip(*(b.column(c).to_pylist() for c in ("node", "label", "data", "base", "probe"))):
                base, probe = np.frombuffer(base, np.int64), np.frombuffer(probe, np.int64).reshape(-1, PROBES)
                head = f"{len(data)}:{label}:".encode()
                for t in range(len(base)):
                    for side, code in ((0, int(base[t])), *((1, int(c)) for c in probe[t] if c >= 0)):
                        at = t << 56 | (code & ((1 << 56) - 1))
                        for column, value in zip(rows, (int.from_bytes(hashlib.blake2b(head + at.to_bytes(8, "big"), digest_size=8).digest(), "big", signed=True), at, side, node)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["bucket", "at", "side", "node"])

    return reps.select("node", "label", "data", "base", "probe").mapInArrow(look, "bucket long, at long, side int, node long")


def tiles(stood: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows for compare(): those of a bucket in blocks of BLOCK, each pair of blocks that may meet in a tile."""
    sized = stood.groupBy("bucket").agg(F.sum((F.col("side") == 0).cast("long")).alias("n0"), F.sum("side").alias("n1")).where("n0 > 0 and n0 + n1 > 1")
    sized = sized.select("bucket", F.ceil(F.col("n0") / BLOCK).cast("int").alias("k0"), F.ceil(F.col("n1") / BLOCK).cast("int").alias("k1"))
    x = stood.join(sized, "bucket")
    i = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("k0")).otherwise(F.greatest("k1", F.lit(1)))).cast("int")
    x = x.withColumn("i", i)
    bucket, i = F.col("bucket"), F.col("i")

    def pick(k, tile, role):
        made = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(tile(j).alias("tile"), role(j).cast("int").alias("role")))
        return F.when(k > 0, made).otherwise(F.array().cast("array<struct<tile:long,role:int>>"))

    half = lambda j: F.when(i == j, F.lit(0)).when(i < j, F.lit(1)).otherwise(F.lit(2))
    own = F.concat(pick(F.col("k0"), lambda j: F.xxhash64(bucket, F.least(i, j), F.greatest(i, j), F.lit(0)), half), pick(F.col("k1"), lambda j: F.xxhash64(bucket, i, j, F.lit(1)), lambda j: F.lit(3)))
    other = pick(F.col("k0"), lambda j: F.xxhash64(bucket, j, i, F.lit(1)), lambda j: F.lit(4))
    x = x.select("bucket", "at", "node", F.explode(F.when(F.col("side") == 0, own).otherwise(other)).alias("x")).select("x.tile", "x.role", "bucket", "at", "node")
    return x.join(reps.select("node", "copies", "data", "base", "probe"), "node")


def compare(t: pa.Table) -> pa.Table:
    """kind 0: with how many vectors a node is linked, by pairs that this tile owns; kind 1: pairs of nodes that chain what is linked here.

    Roles: 0 meets 0 (one block), 1 meets 2 (two blocks that stand in the bucket), 3 meets 4 (standing and probing).
    Of all tiles in which a pair meets, the one of its first table, and there of one bucket by a rule of both codes, owns it.
    """
    tile, role, node, copies, at, bucket = (t.column(c).to_numpy() for c in ("tile", "role", "node", "copies", "at", "bucket"))
    data, base, probe = (t.column(c).to_pylist() for c in ("data", "base", "probe"))
    order = np.lexsort((node, tile))
    links: dict[int, int] = {}
    chains = set()
    for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        left, right = part[np.isin(role[part], (0, 1, 3))], part[np.isin(role[part], (0, 2, 4))]
        if not len(left) or not len(right) or len(part) < 2:
            continue
        x, y = (unit(np.frombuffer(b"".join(data[i] for i in side), np.float64).reshape(len(side), -1)) for side in (left, right))
        near = x @ y.T >= COSINE
        if role[part[0]] == 0:
            near = np.triu(near, 1)
        p, q = np.nonzero(near)
        p, q = left[p], right[q]
        some = (node[p] != node[q]) & (bucket[p] == bucket[q])
        p, q = p[some], q[some]
        if not len(p):
            continue
        used, where = np.unique(np.concatenate([p, q]), return_inverse=True)
        b = np.frombuffer(b"".join(base[i] for i in used), np.int64).reshape(len(used), -1)
        o = np.frombuffer(b"".join(probe[i] for i in used), np.int64).reshape(len(used), b.shape[1], PROBES)
        i, j = where[: len(p)], where[len(p) :]
        met = b[i] == b[j]
        for k in range(PROBES):
            met |= (o[i, :, k] == b[j]) | (o[j, :, k] == b[i])
        first = met.argmax(1)
        bi, bj = b[i, first], b[j, first]
        i_probes, j_probes = (o[i, first] == bj[:, None]).any(1), (o[j, first] == bi[:, None]).any(1)
        at_code = np.where(bi == bj, bi, np.where(i_probes & j_probes, np.minimum(bi, bj), np.where(i_probes, bj, bi)))
        mine = (first == at[p] >> 56) & (at_code == at[p] & ((1 << 56) - 1))
        for u, k in ((p[mine], copies[q[mine]]), (q[mine], copies[p[mine]])):
            for name, n in zip(*_summed(node[u], k)):
                links[name] = links.get(name, 0) + n
        label = np.arange(len(used))
        while True:  # least labels spread over the pairs
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        chain = np.lexsort((node[used], label))
        linked = label[chain[:-1]] == label[chain[1:]]
        chains.update(zip(node[used[chain[:-1]]][linked].tolist(), node[used[chain[1:]]][linked].tolist()))
    rows = [(0, u, n) for u, n in links.items()] + [(1, u, v) for u, v in chains]
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "u": pa.array([r[1] for r in rows], pa.int64()), "v": pa.array([r[2] for r in rows], pa.int64())})


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    names, which = np.unique(keys, return_inverse=True)
    return names.tolist(), np.bincount(which.ravel(), values, len(names)).astype(np.int64).tolist()


def near_vectors(vectors: DataFrame) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id (the least vec_id that links lead to, its own included), kept.

    Vectors of one label and one length link when their cosine in double precision is at least COSINE. Null labels, and
    vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Equal vectors are linked
    and hashed once. Rows that repeat a vec_id are vectors of their own.
    """
    names = stage(named(vectors), "vectors-named")
    reps = names.where("node is not null").groupBy("node", "label", "data").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    reps = stage(reps, "vectors-reps")
    shape = reps.groupBy("label", F.length("data").alias("by")).count().agg(F.max("count"), F.max("by")).first()
    hashes, tables = plan(shape[0] or 1, max(2, 1 << ((shape[1] or 16) // 8 - 1).bit_length()))
    coded = stage(hashed(reps, hashes, tables), "vectors-coded")
    met = stage(tiles(stands(coded), coded), "vectors-tiles")
    calls = max(8, -(-met.count() // CALL_ROWS))
    found = met.withColumn("call", F.pmod("tile", F.lit(calls))).groupBy("call").applyInArrow(compare, "kind int, u long, v long")
    found = stage(found, "vectors-found")
    drop(met)
    degrees = found.where("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("linked"))
    labels = components(found.where("kind = 1").select("u", "v"))
    about = reps.join(degrees, "node", "left").join(labels, "node", "left").select("node", "first", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    about = stage(about, "vectors-about")
    least = about.groupBy("root").agg(F.min("first").alias("component_id"))
    about = about.join(least, "root").select("node", "n_links", "component_id")
    out = names.select("vec_id", "node").join(about, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE t AS (SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT *, list_inner_product(e, e) AS s FROM t WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.r AS p, b.r AS q FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r < b.r WHERE list_inner_product(a.e, b.e) / sqrt(a.s * b.s) >= {COSINE}),
e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
c AS (SELECT r AS p, r AS q FROM t UNION SELECT c.p, e.q FROM c JOIN e ON c.q = e.p),
m AS (SELECT c.p, min(u.vec_id) AS component_id FROM c JOIN t u ON u.r = c.q GROUP BY c.p)
SELECT t.vec_id, (SELECT count(*) FROM e WHERE e.p = t.r)::BIGINT AS n_links, m.component_id, m.component_id = t.vec_id AS kept FROM t JOIN m ON m.p = t.r
"""
