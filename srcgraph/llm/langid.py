"""Language of whole texts by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a word, with a mark for its
start, is the sum over all its segmentations into pieces, from the forward algorithm; expectation-maximisation fits the
pieces' probabilities to the words of a bounded sample of labelled texts.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.session import settle

from . import textkit
from .staging import read

VOCABULARY = "piece_bpe_32k.model"
#: Labelled texts of a language that are learned from, about, and of all languages.
PER_LANGUAGE, SAMPLE = 400, 20_000
#: Symbols of a stretch of a word; longer words are cut into stretches.
STRETCH = 48
ROUNDS, SMOOTH, SCALE = 4, 0.05, 24.0
#: Pieces for letters that the vocabulary lacks, by their block.
BLOCKS = 64
NONE = "und"
#: Words that a worker keeps.
KEPT = 150_000


class Vocabulary:
    """All pieces of letters of a vocabulary, as a trie in a hash table of its steps. Letters that it lacks are pieces by their block."""

    def __init__(self, path: str):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(path))
        texts = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        texts = {t for t in texts if t.replace("▁", "", 1).isalpha()}
        letters = sorted({"▁", *(c for t in texts for c in t)})
        self.index = np.full(0x110000, -1, np.int32)
        for i, c in enumerate(letters):
            self.index[ord(c)] = i
        self.letters = len(letters)
        self.pieces = sorted({*texts, *letters})
        self.longest = max(map(len, self.pieces))
        places, steps, pieces = {"": 0}, [], [-1]
        for k, t in enumerate(self.pieces):
            for i, c in enumerate(t):
                if t[: i + 1] not in places:
                    places[t[: i + 1]] = len(places)
                    steps.append(places[t[:i]] * self.letters + int(self.index[ord(c)]))
                    pieces.append(-1)
            pieces[places[t]] = k
        self.piece = np.array(pieces, np.int32)
        self.n = len(self.pieces) + BLOCKS
        # step i leads to node i + 1; a place of the table is taken by at most one, those that collide go on to the next
        self.mask = (1 << (4 * len(steps)).bit_length()) - 1
        self.steps, self.nodes = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        self.probes = 1
        for node, (step, at) in enumerate(zip(steps, self.places(np.array(steps, np.int64)).tolist()), 1):
            n = 1
            while self.steps[at] >= 0:
                at, n = (at + 1) & self.mask, n + 1
            self.steps[at], self.nodes[at] = step, node
            self.probes = max(self.probes, n)

    def places(self, steps: np.ndarray) -> np.ndarray:
        return (textkit.mix64(steps.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def after(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node that each letter leads to from each node, or -1."""
        steps = nodes.astype(np.int64) * self.letters + letters
        at, out = self.places(steps), np.full(len(steps), -1, np.int32)
        left = np.flatnonzero(letters >= 0)
        for _ in range(self.probes):
            there = self.steps[at[left]]
            hit = there == steps[left]
            out[left[hit]] = self.nodes[at[left[hit]]]
            left = left[~hit & (there >= 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
        return out

    def segments(self, words: np.ndarray) -> list[np.ndarray]:
        """words: rows of code points of one length. For each piece length from 1 the piece at each place, or n for none."""
        letter, n = self.index[words], words.shape[1]
        row, place = (x.ravel() for x in np.indices(words.shape))
        node, out = np.zeros(len(row), np.int32), []
        for size in range(1, min(self.longest, n) + 1):
            if not len(row):
                out.append(np.broadcast_to(np.int32(self.n), (len(words), n - size + 1)))
                continue
            fits = place + size <= n
            row, place = row[fits], place[fits]
            node = self.after(node[fits], letter[row, place + size - 1])
            on = node >= 0
            row, place, node = row[on], place[on], node[on]
            found = np.full((len(words), n - size + 1), self.n, np.int32)
            own = self.piece[node]
            whole = own >= 0
            found[row[whole], place[whole]] = own[whole]
            if size == 1:
                found = np.where(letter < 0, len(self.pieces) + (words >> 8).astype(np.int32) % BLOCKS, found)
            out.append(found)
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def forward(pieces: list[np.ndarray], p: np.ndarray) -> list[np.ndarray]:
    """alpha[i]: probability, times SCALE per symbol, of the first i symbols. p: a row a piece and one of zeros, a column a language."""
    n, none = pieces[0].shape[1], len(p) - 1
    alpha = [np.ones((len(pieces[0]), p.shape[1]))]
    for i in range(1, n + 1):
        a = np.zeros_like(alpha[0])
        for size in range(1, min(len(pieces), i) + 1):
            found = pieces[size - 1][:, i - size]
            own = np.flatnonzero(found < none)  # long pieces are few
            if 4 * len(own) > len(found):
                a += alpha[i - size] * p[found] * SCALE**size
            elif len(own):
                a[own] += alpha[i - size][own] * p[found[own]] * SCALE**size
        alpha.append(np.maximum(a, 1e-280))
    return alpha


def expected(vocab: Vocabulary, words: np.ndarray, times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected counts of pieces in words of one length, under one language's p."""
    pieces = vocab.segments(words)
    alpha, n = forward(pieces, p[:, None]), words.shape[1]
    beta = [np.ones(len(words)) for _ in range(n + 1)]
    out = np.zeros(vocab.n + 1)
    for i in range(n - 1, -1, -1):
        b = np.zeros(len(words))
        for size in range(1, min(len(pieces), n - i) + 1):
            own = np.flatnonzero(pieces[size - 1][:, i] < vocab.n)
            if not len(own):
                continue
            found = pieces[size - 1][own, i]
            through = p[found] * SCALE**size * beta[i + size][own]
            b[own] += through
            np.add.at(out, found, alpha[i][own, 0] * through / alpha[n][own, 0] * times[own])
        beta[i] = np.maximum(b, 1e-280)
    out[-1] = 0
    return out


def stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with word marks, starts and ends of stretches (mark included), and the text of each."""
    codes, starts = textkit.joined([t.lower() for t in texts])
    first, last = textkit.runs(textkit.table("L")[codes])
    if len(first) and (last - first).max() >= STRETCH:
        k = -(-(last - first) // (STRETCH - 1))
        which = np.repeat(np.arange(len(first)), k)
        step = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        first, last = first[which] + step * (STRETCH - 1), np.minimum(last[which], first[which] + (step + 1) * (STRETCH - 1))
    return codes, first, last, np.searchsorted(starts, first, "right") - 1


def by_length(codes: np.ndarray, first: np.ndarray, last: np.ndarray):
    """(which, rows of code points with the mark before) for each length."""
    size = last - first
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        rows = codes[first[which][:, None] + np.arange(n)]
        yield which, np.concatenate([np.full((len(which), 1), 0x2581, np.uint32), rows], 1)


def fit(samples: dict[str, list[str]], path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and p, a column for each."""
    vocab, columns = vocabulary(path), []
    for lang in sorted(samples):
        codes, first, last, _ = stretches(samples[lang])
        keys, one, times = np.unique(textkit.hashes(codes, first, last), return_index=True, return_counts=True)
        groups = [(rows, times[which]) for which, rows in by_length(codes, first[one], last[one])]
        counts = np.zeros(vocab.n + 1)
        for rows, k in groups:
            for found in vocab.segments(rows):
                counts += np.bincount(found.ravel(), np.repeat(k, found.shape[1]), vocab.n + 1)
        for _ in range(ROUNDS):
            counts[-1] = 0
            p = counts + SMOOTH
            p[-1] = 0
            p /= p.sum()
            counts = sum((expected(vocab, rows, k, p) for rows, k in groups), np.zeros(vocab.n + 1))
        p = counts + SMOOTH
        p[-1] = 0
        columns.append(p / p.sum())
    return sorted(samples), np.array(columns).T if columns else np.zeros((vocab.n + 1, 0))


class Scorer:
    def __init__(self, p: np.ndarray, path: str):
        self.vocab, self.p = vocabulary(path), p
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.logs = np.zeros((1024, self.p.shape[1]))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ln P(text | language), a row a text, and how many words."""
        if len(self.at) > KEPT:
            self.clear()
        codes, first, last, text = stretches(texts)
        keys, one, which = np.unique(textkit.hashes(codes, first, last), return_index=True, return_inverse=True)
        places, new = np.empty(len(keys), np.int64), []
        for i, k in enumerate(keys.tolist()):
            place = self.at.get(k)
            if place is None:
                place = self.at[k] = len(self.at)
                new.append(i)
            places[i] = place
        while len(self.at) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        new = np.array(new, np.int64)
        for own, rows in by_length(codes, first[one[new]], last[one[new]]):
            self.logs[places[new[own]]] = np.log(forward(self.vocab.segments(rows), self.p)[-1]) - rows.shape[1] * np.log(SCALE)
        row = places[which.ravel()]
        out = np.stack([np.bincount(text, self.logs[row, j], len(texts)) for j in range(self.p.shape[1])], 1)
        return out, np.bincount(text, minlength=len(texts))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """A model of the languages of docs (doc_id, text, lang): about per_language texts of each, drawn by a hash of doc_id."""
    known = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE // 4).collect()}
    each = max(4, min(per_language, SAMPLE // max(1, len(counts))))
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))]), F.col("lang")), F.lit(0.0)) if counts else F.lit(0.0)
    drawn = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << 30)) / float(1 << 30)) < share
    samples: dict[str, list[str]] = {}
    for r in known.where(drawn).select("lang", "text").orderBy("lang", F.xxhash64("text")).collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    model = fit(samples, path)
    del samples
    vocabulary.cache_clear()  # workers have their own
    settle(docs.sparkSession)
    return model


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str = VOCABULARY, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns in carry) with lang_pred and score, the posterior of lang_pred under equal priors.

    'und' and 0 where text is null or has no letter, or the model knows no language. Ties go to the first language by name.
    """
    names, p = model
    shipped = docs.sparkSession.sparkContext.broadcast(p)
    docs = docs.drop("lang_pred", "score")
    carry = docs.columns if carry is None else carry

    def look(batches):
        scorer = Scorer(shipped.value, path)
        for rows, texts, _ in textkit.chunks(batches):
            if names:
                logs, words = scorer.score(texts)
                best = logs.argmax(1)
                score = 1 / np.exp(np.clip(logs - logs.max(1, keepdims=True), -700, 0)).sum(1)
                langs = [names[b] if w else NONE for b, w in zip(best.tolist(), words.tolist())]
                score = np.where(words > 0, score, 0.0)
            else:
                langs, score = [NONE] * len(texts), np.zeros(len(texts))
            yield from rows.select(carry).append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(score)).to_batches()

    return docs.mapInArrow(look, T.StructType([*docs.select(*carry).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def remainder(column: Column, n: int) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = learn(docs.where("not held_out").select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", "held_out"), model, carry=["doc_id", "held_out"])


#: A text whose best language is less likely than not is rejected, as is one without letters.
REJECT = 0.5


def langid_stage(docs: DataFrame) -> DataFrame:
    """docs without those of no language: no letter, or no language likelier than the others together.

    Null and empty texts go; a very long text is scored whole. Rows that repeat are judged alike, whatever their doc_id. Without a
    text whose language is known nothing can be learned, and only texts without letters go. The columns are those of docs.
    """
    model = learn(docs.select("doc_id", "text", "lang"))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}  # such columns stay as they are
    found = predict(docs.withColumnsRenamed(own), model)
    kept = found.where((F.col("lang_pred") != NONE) & (F.col("score") >= REJECT)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: c for c, new in own.items()}).select(*docs.columns)
