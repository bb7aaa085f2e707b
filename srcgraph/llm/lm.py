"""Stupid-backoff scores of documents under word bigram counts of the whole corpus.

S(w | v) = c(v w) / c(v) if c(v w) >= min_count, else alpha * c(w) / N. Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a
document's first word follows a start mark, which c counts too. A sender, about HELD words of one task, sends each of its
different words and bigrams once, with how often it has it, to the owner of the key's hash range. An owner adds up the counts
of all senders and answers each with the whole counts, in the order of its keys, so that counts need no keys with them. The
sender's documents, as numbers of its words, go round the owners and meet the answers, which are joined to the occurrences
there; a document is never cut, so its sum is made in one place. A key comes to its owner once for each sender however
frequent it is, and what is sent and held for a word doesn't grow with the corpus.
Words are told apart by 64 bits of a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .staging import read, stage

ALPHA, MIN_COUNT = 0.4, 2
#: Words, or documents, of a sender, about; a longer text is a sender of its own.
HELD = 1_500_000
#: Bytes of rows that a task gives to Spark at once, about.
GIVEN = 4_000_000
START = np.uint64(0x0123456789ABCDEF)
U = np.uint64


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word: its hash, that of the word before or START, and the number of its text."""
    codes, starts = textkit.joined(texts)
    codes = textkit.lowered(codes)
    first, last = textkit.runs(~textkit.table("ascii_space")[codes])
    w = textkit.hashes(codes, first, last)
    doc = np.searchsorted(starts, first, "right") - 1
    v = np.concatenate(([START], w[:-1])) if len(w) else w
    return w, np.where(np.diff(doc, prepend=-1) != 0, START, v), doc


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return textkit.mix64(v * textkit.BASE + w)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The owner of each key; owners have ranges of keys, in order."""
    return ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def groups(keys: np.ndarray) -> np.ndarray:
    """Where in sorted keys a new one starts."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, sorted, how often each is there, and which of them each key is."""
    order = np.argsort(keys)
    head = groups(ordered := keys[order])
    times = np.diff(np.append(head, len(keys)))
    which = np.empty(len(keys), np.uint32)
    which[order] = np.repeat(np.arange(len(head), dtype=np.uint32), times)
    return ordered[head], times, which


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys; many of them as their lower 48 bits, with how many there are of each of the upper 16."""
    top = (keys >> U(48)).astype(np.int64)
    first, width = int(top[0]), int(top[-1] - top[0]) + 1
    if width * 2 > len(keys):
        return np.array([len(keys), 0, 0], np.uint32).tobytes() + keys.tobytes()
    head = np.array([len(keys), width, first], np.uint32).tobytes() + np.bincount(top - first, minlength=width).astype(np.uint32).tobytes()
    return head + keys.astype(np.uint32).tobytes() + (keys >> U(32)).astype(np.uint16).tobytes()


def unpack_keys(blob: bytes) -> tuple[np.ndarray, int]:
    """The keys of pack_keys(), and where in the blob they end."""
    n, width, first = np.frombuffer(blob, np.uint32, 3).tolist()
    if not width:
        return np.frombuffer(blob, U, n, 12), 12 + 8 * n
    at = 12 + 4 * width
    top = np.repeat(np.arange(first, first + width, dtype=U), np.frombuffer(blob, np.uint32, width, 12))
    low, middle = np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, np.uint16, n, at + 4 * n)
    return top << U(48) | middle.astype(U) << U(32) | low, at + 6 * n


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as a byte each; larger ones beside, with their places."""
    large = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(np.uint32).tobytes() + counts[large].astype(np.int64).tobytes()


def unpack_counts(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    """The n counts of pack_counts() that stand at the end of a blob."""
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    m = (len(blob) - at - n) // 12
    counts[np.frombuffer(blob, np.uint32, m, at + n)] = np.frombuffer(blob, np.int64, m, at + n + 4 * m)
    return counts


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as all their lowest bytes, then the next ones: Spark's compression takes out those that are zero."""
    return np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(blob: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel()


def pack_documents(ids: pa.Array, n: np.ndarray, times: np.ndarray, which: np.ndarray) -> bytes:
    """Documents' ids and numbers of words, and which word of the sender's sorted ones each word is, by rank of frequency."""
    by_rank = np.argsort(-times, kind="stable")
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    head = np.array([len(n), len(by_rank), len(which)], np.int64).tobytes() + ids.fill_null(0).to_numpy().astype(np.int64).tobytes()
    return b"".join([head, missing.tobytes(), n.astype(np.int64).tobytes(), planes(by_rank), planes(rank[which])])


def unpack_documents(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """ids, numbers of words, and the words' places among the sender's sorted ones."""
    m, k, total = np.frombuffer(blob, np.int64, 3).tolist()
    ids = pa.array(np.frombuffer(blob, np.int64, m, 24), mask=np.frombuffer(blob, bool, m, 24 + 8 * m))
    at = 24 + 9 * m
    n = np.frombuffer(blob[at : at + 8 * m], np.int64)
    return ids, n, unplanes(blob, k, at + 8 * m)[unplanes(blob, total, at + 8 * m + 4 * k)]


COLUMNS = (("kind", pa.int32()), ("part", pa.int64()), ("sender", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()))
SCHEMA = "kind int, part long, sender long, n long, blob binary"
#: Kinds of rows: a sender's documents; keys and counts of its words, its bigrams, and, from owners, whole counts; how many words an owner has.
DOCUMENTS, WORDS, PAIRS, TOTAL = range(4)


def batch(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(COLUMNS)], names=[c for c, _ in COLUMNS])


def lm_scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """A row for each document: doc_id, n_words, n_seen (bigrams that count), log_score (sum of ln S), score (its mean).

    Null and empty texts have no words, log_score 0 and a null score. Equal texts have equal scores up to the order of
    sums; rows that repeat a doc_id are documents of their own. No documents, no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts, most = max(8, docs.rdd.getNumPartitions()), HELD

    def beside(sender: int) -> int:
        """A part of its own kind for rows that owners only pass on, spread evenly."""
        return parts + int(textkit.mix64(np.array([sender], U))[0] % U(64 * parts))

    def rows_of(sender: int, held: list[tuple]):
        w, v, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        ids = pa.concat_arrays([a for h in held for a in h[3].chunks])
        held.clear()
        pairs, starts = pair(v, w), np.full((v == START).sum(), START)
        del v
        # the start mark is a word that is counted but stands nowhere
        words, times, which = different(np.append(w, starts))
        yield DOCUMENTS, beside(sender), sender, None, pack_documents(ids, n, times, which[: len(w)])
        del w, which
        pairs.sort()
        head = groups(pairs)
        for kind, keys, counts in ((WORDS, words, times), (PAIRS, pairs[head], np.diff(np.append(head, len(pairs))))):
            edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[p], edges[p + 1]
                yield kind, p, sender, None, pack_keys(keys[a:b]) + pack_counts(counts[a:b])

    def send(batches):
        task, count, held, size, place = TaskContext.get().partitionId(), 0, [], 0, 0

        def tell():
            rows, given = [], 0
            for row in rows_of(task << 20 | count, held):
                rows.append(row)
                given += len(row[-1])
                if given >= GIVEN:
                    yield from batch(rows).to_batches()
                    rows, given = [], 0
            if rows:
                yield from batch(rows).to_batches()

        for rows, texts, _ in textkit.chunks(batches):
            w, v, doc = bigrams(texts)
            if held and size + len(w) > most:
                yield from tell()
                held, size, place, count = [], 0, 0, count + 1
            held.append((w, v, np.bincount(doc, minlength=len(texts)), rows.column("doc_id")))
            size, place = size + len(w), place + len(texts)
            if max(size, place) >= most:
                yield from tell()
                held, size, place, count = [], 0, 0, count + 1
        if held:
            yield from tell()

    def own(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_numpy()
        if kinds[0] == DOCUMENTS:
            return t
        part, senders, rows = t.column("part")[0].as_py(), t.column("sender").to_pylist(), []
        for kind in (WORDS, PAIRS):
            at = np.flatnonzero(kinds == kind)
            if not len(at):
                continue
            blobs = t.column("blob").take(pa.array(at)).to_pylist()
            keys, counts, ends = [], [], []
            for blob in blobs:
                own, end = unpack_keys(blob)
                keys.append(own)
                counts.append(unpack_counts(blob, len(own), end))
                ends.append(end)
            sizes = [len(k) for k in keys]
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            del own
            if kind == WORDS:
                rows.append((TOTAL, part, None, int(counts[keys != START].sum()), None))
            order = np.argsort(keys)
            head = groups(keys[order])
            counts[order] = np.repeat(np.add.reduceat(counts[order], head), np.diff(np.append(head, len(keys))))
            del keys, order, head
            edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
            for i, a, b, blob, end in zip(at.tolist(), edges[:-1], edges[1:], blobs, ends):
                rows.append((kind, part, senders[i], b - a, (blob[:end] if kind == WORDS else b"") + pack_counts(counts[a:b])))
        return batch(rows)

    owned = stage(docs.mapInArrow(send, SCHEMA).groupBy("part").applyInArrow(own, SCHEMA), "lm-owned", row_group=16 << 20)
    total = owned.where(F.col("kind") == TOTAL).agg(F.sum("n")).first()[0] or 0

    def close(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")  # owners have ranges of keys, so answers in their order are in the order of the keys
        kinds, sizes, blobs = t.column("kind").to_numpy(), t.column("n").to_pylist(), t.column("blob").to_pylist()
        ids, n, which = unpack_documents(blobs[int(np.flatnonzero(kinds == DOCUMENTS)[0])])
        doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        sums, hits = np.zeros(len(n)), np.zeros(len(n), np.int64)
        if len(which):
            keys, c = [], []
            for i in np.flatnonzero(kinds == WORDS).tolist():
                own, end = unpack_keys(blobs[i])
                keys.append(own)
                c.append(unpack_counts(blobs[i], len(own), end))
            keys, c = np.concatenate(keys), np.concatenate(c)
            c_pair = np.concatenate([unpack_counts(blobs[i], sizes[i]) for i in np.flatnonzero(kinds == PAIRS).tolist()])
            before = np.concatenate((which[:1], which[:-1]))
            before[np.concatenate(([True], doc[1:] != doc[:-1]))] = np.searchsorted(keys, START)
            pairs = pair(keys[before], keys[which])
            order = np.argsort(pairs)
            head = groups(pairs[order])
            v, w = c[before[order[head]]], c[which[order[head]]]
            seen = c_pair >= min_count
            value = np.where(seen, np.log(c_pair) - np.log(v), np.log(alpha) + np.log(w) - np.log(total))
            times, doc = np.diff(np.append(head, len(order))), doc[order]
            del pairs, order, before, which
            sums = np.bincount(doc, np.repeat(value, times), len(n))
            hits = np.bincount(doc, np.repeat(seen, times), len(n)).astype(np.int64)
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": ids, "n_words": n, "n_seen": hits, "log_score": sums, "score": mean})

    answers = owned.where(F.col("kind") != TOTAL)
    return answers.groupBy("sender").applyInArrow(close, "doc_id long, n_words long, n_seen long, log_score double, score double")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
b AS (SELECT doc_id, r, unnest(ws) AS w, unnest(list_prepend(' ', ws[:-2])) AS v FROM t),
n AS (SELECT count(*) AS n FROM b),
c1 AS (SELECT w, count(*) AS c FROM b GROUP BY w UNION ALL SELECT ' ', count(*) FROM b WHERE v = ' '),
c2 AS (SELECT v, w, count(*) AS c FROM b GROUP BY v, w),
s AS (SELECT r, c2.c >= 2 AS seen, CASE WHEN c2.c >= 2 THEN ln(c2.c) - ln(x.c) ELSE ln(0.4) + ln(y.c) - ln(n.n) END AS l
  FROM b JOIN c2 USING (v, w) JOIN c1 x ON x.w = b.v JOIN c1 y ON y.w = b.w, n)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, coalesce(count(*) FILTER (WHERE seen), 0)::BIGINT AS n_seen, coalesce(sum(l), 0) AS log_score, sum(l) / nullif(len(t.ws), 0) AS score
FROM t LEFT JOIN s USING (r) GROUP BY t.r, t.doc_id, t.ws
"""
