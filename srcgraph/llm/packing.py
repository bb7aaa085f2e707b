"""Best-fit packing of token sequences by patterns of lengths.

The corpus enters the plan only as a histogram of piece lengths, so the plan's size depends on the sequence length alone.
Patterns of few pieces that fill a sequence are fitted to the histogram by non-negative least squares, rounded down, and
what is left is packed best-fit decreasing. Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from collections import defaultdict
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .numbering import hex_key, running
from .staging import read, stage

LENGTH = 1024
END = 2
DEPTH = 3
ROUNDS = 200
VOCABULARY = "byte_bpe_50k"
#: White_Space code points.
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: Distinct pieces whose ids a worker keeps.
KEPT = 400_000


@cache
def classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            out[c] = LETTER if kind[0] == "L" else DIGIT
        elif kind == "Cn":
            out[c] = UNKNOWN  # perhaps a letter in a later Unicode than Python's
    out[list(SPACES)] = SPACE
    return out


def starts_of_pieces(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level vocabulary's pattern start: runs of letters, digits or other signs, each with one
    space before it; English contractions; white space up to the last character before a run. texts: starts of texts."""
    kind = classes()[codes]
    n = len(codes)
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[texts[texts < n]] = True
    space = kind == SPACE
    head = np.flatnonzero(first & ~space)
    inner = head[head > 0]
    inner = inner[~np.isin(inner, texts)] if len(texts) else inner
    before = inner - 1
    blank = before[space[before]]
    # the last blank before a run is a piece of its own, or the head of the run if it is a plain space
    first[blank] = True
    first[before[codes[before] == 32] + 1] = False
    quote = np.flatnonzero((codes == 39) & first)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & first[quote + 1]]
    if len(quote):
        a, b = codes[quote + 1], codes[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        two &= (quote + 2 < n) & ~first[np.minimum(quote + 2, n - 1)]
        for q, k in ((quote[one], 1), (quote[two & ~one], 2)):
            first[q + 1] = False
            first[(q + 1 + k)[q + 1 + k < n]] = True
    return np.flatnonzero(first)


class Tokens:
    """Token ids of whole texts, as the public tokenizer gives them; each distinct piece is encoded once."""

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{name}.json")
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    @cached_property
    def whole(self):
        """The library's tokenizer, which only few texts need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids, self.from_ = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64)
        self.n = 0

    def add(self, pieces: list[str]) -> None:
        new = [self.pieces.encode_ordinary(p) for p in pieces]
        counts = np.fromiter(map(len, new), np.int64, len(new))
        k, used = len(self.at) - len(pieces), self.n
        while used + counts.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(pieces) + 1 > len(self.from_):
            self.from_ = np.concatenate([self.from_, np.zeros_like(self.from_)])
        self.ids[used : used + counts.sum()] = np.fromiter((i for x in new for i in x), np.uint32, counts.sum())
        self.from_[k + 1 : k + 1 + len(new)] = used + np.cumsum(counts)
        self.n = used + int(counts.sum())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if len(self.at) > KEPT:
            self.clear()
        codes, starts = textkit.joined(texts)
        odd = {i for i in np.searchsorted(starts, np.flatnonzero(classes()[codes] == UNKNOWN), "right") - 1}
        odd |= {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        ends = starts[1:] - 1  # without separators, which are pieces of their own
        first = starts_of_pieces(codes, np.unique(np.concatenate([starts[:-1], ends])))
        last = np.append(first[1:], len(codes))
        text = np.searchsorted(starts, first, "right") - 1
        inside = first < ends[text]
        first, last, text = first[inside], last[inside], text[inside]
        keys, one, which = np.unique(textkit.hashes(codes, first, last), return_index=True, return_inverse=True)
        at, new = self.at, []
        places = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys.tolist()):
            place = at.get(k)
            if place is None:
                place = at[k] = len(at)
                new.append(i)
            places[i] = place
        if new:
            self.add([codes[first[j] : last[j]].tobytes().decode("utf-32-le", "surrogatepass") for j in one[new].tolist()])
        place = places[which.ravel()]
        from_, count = self.from_[place], self.from_[place + 1] - self.from_[place]
        done = np.zeros(len(place) + 1, np.int64)
        np.cumsum(count, out=done[1:])
        ids = self.ids[np.repeat(from_ - done[:-1], count) + np.arange(done[-1])]
        cut = done[np.searchsorted(text, np.arange(len(texts) + 1))]
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
        for i in odd:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each text: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A null text counts as empty; an empty text is one piece with the end id. Only texts of more than `length` ids are cut; the first piece takes the remainder.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        tokens = Tokens()
        for rows, texts, _ in textkit.chunks(batches):
            doc_ids, found = rows.column("doc_id").to_pylist(), ([], [], [], [], [], [])
            for doc_id, ids in zip(doc_ids, tokens.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                edges = [0, *range(len(ids) % length or min(length, len(ids)), len(ids) + 1, length)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(found, (doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if with_ids else None)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            k = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(found, types))[:k]], names=list(names[:k]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def patterns(length: int, depth: int) -> np.ndarray:
    """Rows of `depth` lengths in falling order, 0 for none, that add up to `length`."""
    found = [(length, *[0] * (depth - 1))] if depth else []
    if depth >= 2:
        found += [(length - a, a, *[0] * (depth - 2)) for a in range(1, length // 2 + 1)]
    if depth >= 3:
        found += [(length - a - b, b, a, *[0] * (depth - 3)) for a in range(1, length // 3 + 1) for b in range(a, (length - a) // 2 + 1)]
    return np.array(found, np.int64)


def fit(histogram: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every pattern to use, so that each piece of the histogram has one place. histogram[n]: pieces of n ids."""
    left = histogram.astype(np.int64).copy()
    p = patterns(length, DEPTH)
    p = p[np.all((left[p] > 0) | (p == 0), axis=1)]
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    if len(p):
        used = (p > 0).astype(float)
        x, momentum, t = np.zeros(len(p)), np.zeros(len(p)), 1.0
        step = 1 / (np.bincount(p.ravel(), used.ravel(), length + 1).max() * DEPTH)
        for _ in range(rounds):  # accelerated projected gradient on |A x - histogram|^2, x >= 0
            gap = np.bincount(p.ravel(), (used * momentum[:, None]).ravel(), length + 1) - left
            gap[0] = 0
            new = np.maximum(0, momentum - step * (gap[p] * used).sum(1))
            t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            x, momentum = new, new + (was - 1) / t * (new - x)
        for i in np.argsort(-x, kind="stable"):
            k = int(x[i])
            if k < 1:
                break
            own, times = np.unique(p[i][p[i] > 0], return_counts=True)
            if (k := min(k, int((left[own] // times).min()))) > 0:
                left[own] -= k * times
                plan[tuple(p[i][p[i] > 0].tolist())] += k
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by free room
    for size in range(length, 0, -1):
        n = int(left[size])
        for room in sorted(r for r in bins if r >= size):
            while n and bins[room]:
                own, k = next(iter(bins[room].items()))
                fits = min(room // size, -(-n // k))
                each = min(k, n // fits)
                bins[room][own] -= each
                if not bins[room][own]:
                    del bins[room][own]
                bins[room - fits * size][own + (size,) * fits] += each
                n -= each * fits
            if not bins[room]:
                del bins[room]
        fits = length // size
        if n // fits:
            bins[length - fits * size][(size,) * fits] += n // fits
        if n % fits:
            bins[length - n % fits * size][(size,) * (n % fits)] += 1
    for own in bins.values():
        for lengths, k in own.items():
            plan[lengths] += k
    return sorted(plan.items())


def places(plan: list[tuple[tuple[int, ...], int]], length: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece length: first ranks, first sequence ids and offsets of the stretches of its pieces."""
    found: dict[int, list] = defaultdict(list)
    given, sequence = defaultdict(int), 0
    for lengths, k in plan:
        offset = 0
        for size in lengths:
            found[size].append((given[size], sequence, offset))
            given[size] += k
            offset += size
        sequence += k
    return {size: tuple(np.array(x, np.int64).T) for size, x in found.items()}


def pack(docs: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset. Equal rows are pieces of their own; docs without rows give no pieces."""
    rows = stage(pieces(docs, length, with_ids=with_ids).withColumn("_key", hex_key(F.col("doc_id"), F.col("piece"))), "pack-pieces")
    counts = rows.groupBy("length").count().collect()  # at most `length` rows
    histogram = np.zeros(length + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    where = places(fit(histogram, length), length)
    ranked = running(rows, ["length"], "_key", ["doc_id", "start"], F.lit(1), int(histogram.sum()), "_rank").drop("_key")
    names = [c for c in ranked.columns if c != "_rank"]
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = ", ".join(f"{c} {dict(ranked.dtypes)[c]}" for c in order) + ", sequence_id long, offset long"

    def place(batches):
        for b in batches:
            sizes, ranks = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            by = np.argsort(sizes, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(sizes[by])) + 1) if len(by) else []:
                first, ids, at = where[int(sizes[part[0]])]
                i = np.searchsorted(first, ranks[part], "right") - 1
                sequence[part], offset[part] = ids[i] + ranks[part] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in order] + [pa.array(sequence), pa.array(offset)], names=[*order, "sequence_id", "offset"])

    assert set(names) == set(order)
    return ranked.mapInArrow(place, schema)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
