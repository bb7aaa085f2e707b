"""Texts as arrays: kernels shared by the operators that run in Python workers.

A chunk of whole texts becomes one array of code points; pieces of it are hashed with sums of powers, without a loop over characters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Code points that a chunk holds unless a single text is longer.
CHUNK = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each bit of a uint64 over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64; kept for the next chunk."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each codes[start:end]; equal for equal pieces wherever they stand."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + BASE) * powers(BASE, len(codes)), out=sums[1:])
    found = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(codes) + 1)[starts]
    return mix64(found + (ends - starts).astype(np.uint64))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.Table, list[str], np.ndarray]]:
    """Rows in order, as (rows, texts with '' for null, lengths), each chunk of about `limit` code points, or one longer text."""
    held: list[pa.RecordBatch] = []
    texts: list[str] = []
    n = 0
    for batch in batches:
        own = [t or "" for t in batch.column(text).to_pylist()]
        first = 0
        for i, t in enumerate(own):
            n += len(t)
            if n >= limit:
                held.append(batch.slice(first, i + 1 - first))
                texts += own[first : i + 1]
                yield pa.Table.from_batches(held), texts, np.array([len(x) for x in texts], np.int64)
                held, texts, n, first = [], [], 0, i + 1
        if first < len(own):
            held.append(batch.slice(first))
            texts += own[first:]
    if texts:
        yield pa.Table.from_batches(held), texts, np.array([len(x) for x in texts], np.int64)


def joined(texts: list[str], separator: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All code points with a separator after each text, and each text's start."""
    codes = np.frombuffer((separator.join(texts) + separator).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes, starts


@cache
def table(kind: str) -> np.ndarray:
    """A boolean by code point: 'ascii_space' [\\x20\\x09-\\x0D], or a general category's first letter: 'L'."""
    out = np.zeros(sys.maxunicode + 1, bool)
    if kind == "ascii_space":
        out[[32, 9, 10, 11, 12, 13]] = True
    else:
        out[[c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]] = True
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which mask holds."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def lowered(codes: np.ndarray) -> np.ndarray:
    """A-Z in lower case; nothing else changes."""
    return np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
