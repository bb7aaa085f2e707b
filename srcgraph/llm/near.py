"""Near-duplicate texts: an exact Jaccard join of word shingles.

Of similar sets one shingle at least is common to both prefixes, the first quarter of each set in an order all sets share
(frequent shingles last). Sets that share such a shingle meet in tiles: bands of set size, cut into blocks. In a tile the
bits in which two hashed bitmaps differ bound the overlap from above; pairs that pass are intersected as sorted arrays.
Only connected components are wanted. So in first turns only the likeliest pairs of a tile are tested, as many as could join
all of it: for one token of each set, then for the tokens that many sets share. The last turn compares all sets that are still
in different components, without the pairs already found unlike, and a call leaves out pairs that its own links bring together.
No other pair is left out.
A shingle's hash takes more bytes than its share of the text. So of sets only the bitmaps are staged; hashes are worked out again
from the texts, once for all prefixes and in each turn for the sets of pairs that bitmaps don't rule out.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.session import settle

from . import textkit
from .components import components
from .staging import BROADCAST_ROWS, drop, narrow, read, stage, unveiled, veiled

WORDS = 5
#: Shared / united shingles, in hundredths.
LEAST = 75
#: Shingles in so many documents at least may be ordered last; at most MOST_FREQUENT of them are kept, 12 bytes each.
FREQUENT, MOST_FREQUENT = 32, 1_000_000
#: Shingles that a task counts together, and prefix shingles that it sends together.
HELD, SENT = 2_000_000, 250_000
#: Members of a block of a tile, and rows that one call compares.
BLOCK, CALL_ROWS = 1500, 30_000
#: Sets that meet in one tile of the first turn; shingles of the sets of any tile, and of all arrays of a call, about.
MET, TILE_SHINGLES, CALL_SHINGLES = 256, 1_000_000, 2_000_000
#: Scans of the documents for the sets of one turn, each for BROADCAST_ROWS of them; for more, the texts are shuffled.
SCANS = 8
#: Shingles of the sets whose bitmaps one call compares, about; a bitmap has a byte for two at most, but 32 bytes at least.
CALL_BITMAPS = 8_000_000
_FACTORS = textkit.mix64(np.arange(1, 64, dtype=np.uint64) * textkit.BASE) | np.uint64(1)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order of place, and where each text's begin. Fewer words make one shingle; none, none."""
    codes, starts = textkit.joined(texts)
    codes = textkit.lowered(codes)
    first, last = textkit.runs(~textkit.table("ascii_space")[codes])
    hashed = textkit.hashes(codes, first, last)
    n = np.diff(np.searchsorted(first, starts))
    at = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(count, out=edges[1:])
    width = np.repeat(np.minimum(n, words), count)
    place = np.repeat(at - edges[:-1], count) + np.arange(edges[-1])
    out = width.astype(np.uint64)
    padded = np.concatenate([hashed, np.zeros(words, np.uint64)])
    for j in range(words):
        out = out + np.where(j < width, padded[place + j] * _FACTORS[j], np.uint64(0))
    return textkit.mix64(out), edges


def digest(own: np.ndarray) -> int:
    """The number of a set: 64 bits of a digest, signed."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True)


def bits(own: np.ndarray) -> bytes:
    """The parity of how many hashes fall on each of 256 bits or more, two to four bits for each hash."""
    n = 1 << max(8, int(2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(bool), bitorder="little").tobytes()


def sets_of(batches):
    """(rows, their sets, the numbers of these) of batches of documents."""
    for rows, texts, _ in textkit.chunks(batches):
        values, edges = shingles(texts)
        sets = [np.unique(values[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        yield rows, sets, [digest(s) for s in sets]


def first_sets(batches):
    """Lists of (number, set) of batches of documents, without empty sets; each set once."""
    seen = set()
    for _, sets, nodes in sets_of(batches):
        own = {node: s for s, node in zip(sets, nodes) if len(s) and node not in seen}
        seen.update(own)
        yield list(own.items())


def needed(n: int) -> int:
    """The least overlap of a set of n with a similar one."""
    return -(-LEAST * n // 100)


def survey(docs: DataFrame) -> DataFrame:
    """kind 0: a row for each document: doc_id, row, mark if docs have it, node (the number of its set), n; the first one that a task
    meets of a set has place, unlike any other's, and bits. kind 1: a shingle and in how many sets a task met it, if in two or more."""
    more = ["row", *["mark"] * ("mark" in docs.columns)]
    schema = "kind int, doc_id long, node long, n long, place long, bits binary, shingle long" + "".join(f", {c} long" for c in more)

    def look(batches):
        part, held, size, seen = TaskContext.get().partitionId(), [], 0, set()

        def tell():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values, times = values[times > 1], times[times > 1]
            m = len(values)
            longs = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), longs, longs, pa.array(times.astype(np.int64)), longs, pa.nulls(m, pa.binary()), pa.array(values.view(np.int64)), *[longs] * len(more)], names=names)

        for rows, sets, nodes in sets_of(batches):
            places, arrays = [None] * len(sets), [None] * len(sets)
            for i, (s, node) in enumerate(zip(sets, nodes)):
                if len(s) and node not in seen:
                    places[i], arrays[i] = part << 32 | len(seen), s
                    seen.add(node)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), rows.column("doc_id").combine_chunks(), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(places, pa.int64()), pa.array([None if a is None else bits(a) for a in arrays], pa.binary()), pa.nulls(m, pa.int64()), *[rows.column(c).combine_chunks() for c in more]], names=names)
            held += [a for a in arrays if a is not None]
            size += sum(len(a) for a in arrays if a is not None)
            if size >= HELD:
                yield tell()
                held, size = [], 0
        if held:
            yield tell()

    names = ["kind", "doc_id", "node", "n", "place", "bits", "shingle", *more]
    return docs.mapInArrow(look, schema)


def frequent(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: at most MOST_FREQUENT. Any choice gives whole results; this one keeps groups small."""
    counts = surveyed.where("kind = 1").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = stage(counts, "near-frequent")
    by = {r["b"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}
    least, total = 64, 0
    for b in sorted(by, reverse=True):
        if (total := total + by[b]) > MOST_FREQUENT:
            break
        least = b
    kept = counts.where(F.floor(F.log2("n")).cast("int") >= least).toPandas()
    drop(counts)
    values, times = kept["shingle"].to_numpy(np.int64).view(np.uint64), kept["n"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], times[order]


def prefix(own: np.ndarray, values: np.ndarray, times: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """The first n - needed(n) + 1 hashes of a sorted set, frequent ones counted as last, by frequency."""
    k = len(own) - needed(len(own)) + 1
    hot = np.flatnonzero(maybe[(own >> np.uint64(42)).astype(np.int64)])
    if not len(hot) or not len(values):
        return own[:k]
    at = np.minimum(np.searchsorted(values, own[hot]), len(values) - 1)
    found = values[at] == own[hot]
    hot, at = hot[found], at[found]
    mask = np.ones(len(own), bool)
    mask[hot] = False
    out = own[mask][:k]
    return out if len(out) == k else np.concatenate([out, own[hot[np.lexsort((own[hot], times[at]))]][: k - len(out)]])


def shared(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """(token, node, m, leader, sign) for every prefix shingle that two sets or more have. m: how many have the token;
    leader: one of them; sign: a hash of them all."""
    hot = docs.sparkSession.sparkContext.broadcast(hot)

    def send(batches):
        values, times = hot.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(values >> np.uint64(42)).astype(np.int64)] = True
        held, size = [], 0

        def tell():
            tokens = np.concatenate([p for p, _ in held])
            nodes = np.repeat(np.array([d for _, d in held], np.int64).view(np.uint64), [len(p) for p, _ in held])
            order = np.argsort(tokens)
            tokens, nodes = tokens[order], nodes[order]
            part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(part, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(edges))
            low, high = tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint8)
            blobs = [low[a:b].tobytes() + high[a:b].tobytes() + nodes[a:b].tobytes() for a, b in zip(edges[full], edges[full + 1])]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for sets in first_sets(batches):
            for node, own in sets:
                held.append((prefix(own, values, times, maybe), node))
                size += len(held[-1][0])
                if size >= SENT:
                    yield tell()
                    held, size = [], 0
        if held:
            yield tell()

    def meet(t: pa.Table) -> pa.Table:
        part, blobs = t.column("part")[0].as_py(), t.column("blob").to_pylist()
        sizes = [len(b) // 13 for b in blobs]
        tokens = np.concatenate([np.frombuffer(b, np.uint32, n).astype(np.uint64) | np.frombuffer(b, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32) for b, n in zip(blobs, sizes)])
        nodes = np.concatenate([np.frombuffer(b, np.uint64, n, 5 * n) for b, n in zip(blobs, sizes)])
        order = np.argsort(tokens, kind="stable")
        tokens, nodes = tokens[order], nodes[order]
        same = tokens[1:] == tokens[:-1]
        keep = np.zeros(len(tokens), bool)
        keep[1:] |= same
        keep[:-1] |= same
        tokens, nodes = tokens[keep], nodes[keep]
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        once = np.ones(len(tokens), bool)
        once[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        tokens, nodes = tokens[once], nodes[once]
        head = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        m = np.diff(np.append(head, len(tokens)))
        sign = np.bitwise_xor.reduceat(textkit.mix64(nodes), head) if len(head) else np.zeros(0, np.uint64)
        more = np.repeat(m > 1, m)
        names = tokens | np.uint64(part) << np.uint64(40)
        columns = (names, nodes, np.repeat(m, m).astype(np.uint64), np.repeat(nodes[head], m), np.repeat(sign, m))
        return pa.table([pa.array(c[more].view(np.int64)) for c in columns], names=["token", "node", "m", "leader", "sign"])

    sent = docs.select("text").mapInArrow(send, "part int, blob binary")
    return sent.groupBy("part").applyInArrow(meet, "token long, node long, m long, leader long, sign long")


def lists(column) -> list[np.ndarray]:
    """The arrays of hashes of a column of their bytes."""
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def may_match(p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of sizes p and q whose bitmaps differ in `apart` bits may be similar: each such bit is a shingle of one of them alone."""
    common = (p + q - apart) // 2
    return 100 * np.minimum(common, np.minimum(p, q)) >= LEAST * (p + q - np.minimum(common, np.minimum(p, q)))


def fold(own: bytes, width: int) -> np.ndarray:
    """A bitmap as one of `width` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(own, np.uint8).reshape(-1, width), 0)


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets are similar, by intersecting them."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return 100 * common >= LEAST * (len(p) + len(q) - common)


class Forest:
    """Which members of a call its links, and the components they came with, bring together."""

    def __init__(self, comps: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(comps)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def tie(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def candidates(n: np.ndarray, maps: list[bytes], comps: np.ndarray, fits=None):
    """(i, the larger members of other components that sizes and bitmaps don't rule out, the share of shingles that bitmaps tell apart) for each member i. fits(i, others): which may pair with i at all."""
    order = np.argsort(n, kind="stable")
    widths = np.array([len(m) for m in maps])
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    ends = np.searchsorted(n[order], (100 * n[order]) // LEAST, "right")
    for x, i in enumerate(order.tolist()):
        others = order[x + 1 : ends[x]]
        others = others[comps[others] != comps[i]]
        if fits is not None:
            others = others[fits(i, others)]
        if not len(others):
            continue
        width = int(widths[i])  # of the smaller set; the other's is as wide or twice that
        if width not in folded:
            own = np.flatnonzero((widths >= width) & (widths <= 2 * width))
            at = np.full(len(n), -1)
            at[own] = np.arange(len(own))
            folded = {width: (at, np.array([fold(maps[j], width) for j in own]).view(np.uint64))}
        at, words = folded[width]
        apart = np.bitwise_count(words[at[others]] ^ words[at[i]]).sum(1, dtype=np.int64)
        keep = may_match(np.full(len(others), n[i]), n[others], apart)
        if keep.any():
            yield i, others[keep], apart[keep] / (n[i] + n[others[keep]])


def parts_of(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each key."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else []


def with_arrays(needs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """needs (staged, with node) and the hashes of each, sorted, from the text of one document that has them."""

    def look(batches):
        for sets in first_sets(batches):
            for node, own in sets:
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["node", "hashes"])

    asked, docs = classes.select("node", "row").join(narrow(needs.select("node")), "node", "left_semi").select("row"), docs.select("row", "text")
    scans = max(1, -(-asked.count() // BROADCAST_ROWS))
    if scans <= SCANS:
        found = reduce(DataFrame.unionByName, [docs.join(F.broadcast(asked.where(F.pmod("row", F.lit(scans)) == i)), "row", "left_semi") for i in range(scans)])
    else:
        found = docs.join(asked, "row", "left_semi")
    return found.select("text").mapInArrow(look, "node long, hashes binary").join(narrow(needs), "node")


def calls_for(needs: DataFrame) -> int:
    return max(8, -(-(needs.agg(F.sum("n")).first()[0] or 0) // CALL_SHINGLES))


def likeliest(i: np.ndarray, j: np.ndarray, share: np.ndarray, comps: np.ndarray) -> np.ndarray:
    """Of pairs the ones, nearest first, that would join components not joined by nearer ones: fewer than there are members."""
    ties, kept = Forest(comps.tolist()), []
    for k in np.argsort(share, kind="stable").tolist():
        x, y = int(i[k]), int(j[k])
        if ties.root(x) != ties.root(y):
            ties.tie(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def compared(rows: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """Pairs (tile, a, b) of one tile that are in different components and may be similar by size and bitmaps. rows (staged): tile, side, node,
    place, comp, n, m. Sides 1 and 2 pair with each other only. A pair of several tiles gets the one of the largest m.
    forest: of each tile only the likeliest pairs that would join all that may hang together there, fewer than it has members."""
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    calls = max(8, -(-size["rows"] // CALL_ROWS), -(-size["n"] // CALL_BITMAPS))

    def compare(t: pa.Table) -> pa.Table:
        tiles, side, node, comp, n, m = (t.column(c).to_numpy() for c in ("tile", "side", "node", "comp", "n", "m"))
        maps = t.column("bits").to_pylist()
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for part in parts_of(tiles):
            if len(part) < 2 or (comp[part] == comp[part[0]]).all():
                continue
            s, c = side[part], comp[part]
            fits = None if (s == 0).all() else lambda i, others, s=s: s[others] != s[i]
            met = list(candidates(n[part], [maps[x] for x in part], c, fits))
            if not met:
                continue
            one, other = np.concatenate([np.full(len(others), i) for i, others, _ in met]), np.concatenate([others for _, others, _ in met])
            if forest:
                kept = likeliest(one, other, np.concatenate([share for *_, share in met]), c)
                one, other = one[kept], other[kept]
            x, y, rank = node[part[one]], node[part[other]], (int(m[part[0]]), int(tiles[part[0]]))
            for pair in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()):
                found[pair] = max(rank, found.get(pair, rank))
        ranks = list(found.values())
        columns = ([p[0] for p in found], [p[1] for p in found], [r[0] for r in ranks], [r[1] for r in ranks])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "m", "tile"])

    x = sets.select("node", "place", "bits").join(rows, ["node", "place"]).withColumn("call", F.pmod("tile", F.lit(calls)))
    pairs = x.select("call", "tile", "side", "node", "comp", "n", "m", "bits").groupBy("call").applyInArrow(compare, "a long, b long, m long, tile long")
    return stage(pairs.groupBy("a", "b").agg(F.max(F.struct("m", "tile"))["tile"].alias("tile")), "near-pairs")


def verified(pairs: DataFrame, needs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (tile, a, b) that are not similar, as (a, b, false), and components that similar ones join, as (a, b, true).

    Pairs that a call's links bring together anyway are left out. needs: tile, node, n, comp.
    """

    def test(t: pa.Table) -> pa.Table:
        is_set = t.column("b").is_null()
        own, asked = t.filter(is_set), t.filter(t.column("b").is_valid())
        at = {node: i for i, node in enumerate(own.column("node").to_pylist())}
        comps = own.column("comp").to_pylist()
        sets_, ties = lists(own.column("hashes")), Forest(comps)
        a, b, linked = [], [], []
        for p, q in zip(asked.column("node").to_pylist(), asked.column("b").to_pylist()):
            i, j = at[p], at[q]
            if ties.root(i) == ties.root(j):
                continue
            if alike(sets_[i], sets_[j]):
                ties.tie(i, j)
            else:
                a.append(p)
                b.append(q)
                linked.append(False)
        joined = {(comps[ties.root(i)], c) for i, c in enumerate(comps) if comps[ties.root(i)] != c}
        a += [x for x, _ in joined]
        b += [x for _, x in joined]
        linked += [True] * len(joined)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "linked": pa.array(linked, pa.bool_())})

    named = pairs.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct()
    calls = calls_for(named.join(needs.dropDuplicates(["tile", "node"]), ["tile", "node"]))
    own = needs.join(named, ["tile", "node"], "left_semi").withColumn("call", F.pmod("tile", F.lit(calls))).dropDuplicates(["call", "node"])
    own = stage(own, "near-needs")
    rows = with_arrays(own, docs, classes).select("call", "node", "comp", "hashes", F.lit(None).cast("long").alias("b"))
    rows = rows.unionByName(pairs.select(F.pmod("tile", F.lit(calls)).alias("call"), F.col("a").alias("node"), F.lit(None).cast("long").alias("comp"), F.lit(None).cast("binary").alias("hashes"), "b"))
    out = stage(rows.groupBy("call").applyInArrow(test, "a long, b long, linked boolean"), "near-links", wide=True)
    drop(own)
    return out


def relabelled(labels: DataFrame | None, joined: DataFrame) -> DataFrame:
    """labels (node, root) after components (a, b) were joined; a node without a label is a component of its own."""
    new = components(joined.select(F.col("a").alias("u"), F.col("b").alias("v")))
    if labels is None:
        return new
    to = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = stage(old.unionByName(new.join(labels.select("node"), "node", "left_anti")), "near-labels")
    drop(new, labels)
    return out


def blocks_for(count: Column, shingles_: Column, most: int) -> Column:
    """Into how many blocks members are cut, by their number and their shingles."""
    return F.ceil(F.greatest(count / most, shingles_ / TILE_SHINGLES)).cast("int")


def tiled(members: DataFrame) -> DataFrame:
    """Tiles, for compared(), of members (token, node, place, n, m, comp) of a token.

    Few members are one tile. More are dealt by size: sizes of similar sets are at most one band of ratio 4/3 apart; a band is
    cut into blocks, and two blocks, of one band or of neighbours, meet in a tile. tile: the one of the largest token.
    """
    whole = members.groupBy("token").agg(blocks_for(F.count(F.lit(1)), F.sum("n"), BLOCK).alias("whole"))
    band = F.when(F.col("whole") == 1, 0).otherwise(F.floor(F.log("n") / float(np.log(100 / LEAST)) + 1e-9) + 1).cast("int")
    m = members.join(whole, "token").withColumn("band", band)
    blocks = m.groupBy("token", "band").agg(blocks_for(F.count(F.lit(1)), F.sum("n"), BLOCK).alias("k"))
    m = m.join(blocks, ["token", "band"])
    for name, step in (("up", 1), ("down", -1)):
        m = m.join(blocks.select("token", (F.col("band") - step).alias("band"), F.col("k").alias(name)), ["token", "band"], "left")
    m = m.withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))

    def tile(size, key):
        return F.when(size.isNotNull(), F.transform(F.sequence(F.lit(0), size - 1), key)).otherwise(F.array())

    token, b, i = F.col("token"), F.col("band"), F.col("i")
    made = F.concat(
        tile(F.col("k"), lambda j: F.struct(F.xxhash64(token, b, F.least(i, j), F.greatest(i, j), F.lit(0)).alias("tile"), F.lit(0).alias("side"))),
        tile(F.col("up"), lambda j: F.struct(F.xxhash64(token, b + 1, j, i, F.lit(1)).alias("tile"), F.lit(1).alias("side"))),
        tile(F.col("down"), lambda j: F.struct(F.xxhash64(token, b, i, j, F.lit(1)).alias("tile"), F.lit(2).alias("side"))),
    )
    return stage(m.select("node", "place", "comp", "n", "m", F.explode(made).alias("at")).select("at.tile", "at.side", "node", "place", "comp", "n", "m"), "near-tiles")


def labelled(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """kept with comp, the component of each node so far, for the tokens whose members are in several."""
    x = kept.join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    several = x.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    return x.join(several, "token", "left_semi")


def first_tiles(kept: DataFrame) -> DataFrame:
    """tile, side, node, place, n, m, comp: each node in a block of the largest of its tokens."""
    own = kept.groupBy("node").agg(F.max(F.struct("m", "token"))["token"].alias("token"), F.first("place").alias("place"), F.first("n").alias("n"))
    sized = own.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("m > 1")
    own = own.join(sized.select("token", "m", blocks_for(F.col("m"), F.col("s"), MET).alias("k")), "token")
    return own.select(F.xxhash64("token", F.pmod(F.xxhash64("node"), F.col("k"))).alias("tile"), F.lit(0).alias("side"), "node", "place", "n", "m", F.col("node").alias("comp"))


def near_groups(docs: DataFrame, by_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, the least doc_id that links lead to, its own included.

    Links: 100 * common >= 75 * united shingles of five lower-cased words (fewer words: all as one). Without words or text:
    n_shingles 0 and a component of its own. Equal sets are linked. Rows that repeat a doc_id are documents of their own.
    Null doc_ids are never the least one of a component that has another. A very long text is one set like others; only its
    own size bounds what a call holds. No documents, no rows. Other columns of docs are not read.
    docs are read several times, and must give the same rows each time.
    by_text: also mark, the xxhash64 of the text, and root, a number that only one component has, null without words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    seen = stage(survey(docs.withColumn("mark", F.xxhash64("text")) if by_text else docs), "near-survey", "none", 8 << 20)  # bitmaps don't compress, and scans for a few of them should hold little
    more_of = ["mark"] if by_text else []
    # a set is a node
    meta = stage(seen.where("kind = 0").select("doc_id", "node", "n", *more_of), "near-meta")
    classes = seen.where("kind = 0 and n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"), F.min("place").alias("place"), F.min("row").alias("row"))
    classes = stage(classes, "near-classes")
    sets = seen.where("kind = 0 and place is not null")
    tokens = stage(shared(docs, frequent(seen), max(16, 4 * docs.rdd.getNumPartitions())), "near-tokens", wide=True)
    # tokens of the same documents, as those of a passage are, would only repeat the work: one of them stays
    once = tokens.where("node = leader").groupBy("m", "leader", "sign").agg(F.min("token").alias("token")).select("token")
    kept = tokens.select("token", "node", "m").join(once, "token", "left_semi").join(classes.select("node", "n", "place"), "node")
    kept = stage(kept, "near-kept")
    drop(tokens)

    tested, labels = [], None
    # the likeliest pairs for one token of each set, then for the tokens of more sets than a tile of that has, so that few are left when all are compared
    for turn in range(3):
        if turn == 0:
            tiles = stage(first_tiles(kept), "near-first")
        else:
            tiles = tiled(labelled(kept.where(F.col("m") > MET) if turn == 1 else kept, labels))
        if turn == 1 and tiles.isEmpty():
            drop(tiles)
            continue
        pairs = compared(tiles, sets, turn < 2)
        if turn:
            failed = reduce(DataFrame.unionByName, tested).where("not linked").select("a", "b")
            left = stage(pairs.join(failed, ["a", "b"], "left_anti"), "near-open")
            drop(pairs)
            pairs = left
        found = verified(pairs, tiles.select("tile", "node", "n", "comp"), docs, classes)
        labels = relabelled(labels, found.where("linked"))
        tested.append(found)
        drop(tiles, pairs)
        settle(docs.sparkSession)
    drop(kept, seen, *tested)
    named = stage(classes.join(labels, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "near-named")
    drop(labels, classes)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id", "root")
    out = meta.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more_of, *["root"] * by_text)


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


def near_stage(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; of rows that repeat it, one. Without words, all stay.

    Rows are told apart by doc_id, null included, and text. Null doc_ids come after all others. No documents, no rows; the
    columns are those of docs.
    """
    found = stage(near_groups(docs, by_text=True).where("root is not null").select("doc_id", "mark", "root"), "near-found")
    x, names = veiled(docs)
    # a doc_id may be null or in other components too, so it decides together with the text's hash
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    sized = found.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.min(rank).alias("least")).where("m > 1")
    grouped = found.join(sized, "root").select(F.col("doc_id").alias("id"), "mark", rank.eqNullSafe(F.col("least")).alias("stays"))
    pairs = grouped.groupBy("id", "mark").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    pairs = stage(pairs.select("id", "mark", "stays"), "near-pairs")
    drop(found)
    x = x.withColumn("own", F.xxhash64(names["text"]))
    x = x.join(narrow(pairs), x[names["doc_id"]].cast("long").eqNullSafe(pairs["id"]) & (x["own"] == pairs["mark"]), "left")
    return unveiled(x.where("stays is null"), names).unionByName(unveiled(x.where("stays").dropDuplicates(["id", "mark"]), names))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS x FROM t),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (SELECT a.r AS p, b.r AS q FROM s a JOIN s b ON a.x = b.x AND a.r < b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
c AS (SELECT r AS p, r AS q FROM t UNION SELECT c.p, e.q FROM c JOIN e ON c.q = e.p)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(u.doc_id) FROM c JOIN t u ON u.r = c.q WHERE c.p = t.r) AS component_id FROM t LEFT JOIN n ON n.r = t.r
"""
