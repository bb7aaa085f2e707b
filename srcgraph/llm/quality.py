"""Text quality by positive-unlabelled learning.

A linear model on statistics of whole texts minimises the non-negative risk pi R+(P) + max(0, R-(U) - pi R-(P)) with the
logistic loss: P trusted texts, U any texts of the corpus, pi the share of good ones, estimated from P and U alone: no region of
scores can hold a smaller part of U than pi times its part of P, so the least ratio of the two over regions bounds pi and meets
it where bad texts are absent. Labels of bad texts are not used.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .langid import remainder
from .staging import read

#: Trusted texts, and unlabelled ones, that are learned from, about.
SAMPLE = 4000
ROUNDS, RATE, DECAY = 400, 0.05, 2e-3
#: The share of good texts where there are none to estimate it from; and the least share of trusted texts that an estimate rests on.
PRIOR, LEAST_TAIL = 0.8, 0.2
#: Signs with a class of their own.
SIGNS = ".,!?|*#$%&-_/\\:;'\"()[]{}<>@=+~^"
KINDS = 7 + len(SIGNS)


@cache
def classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, 6, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = 1 if kind == "Lu" else 0
        elif kind == "Nd":
            out[c] = 2
        elif kind[0] == "Z":
            out[c] = 3
        elif kind == "Cc":
            out[c] = 5
    out[[9, 32]], out[[10, 13]] = 3, 4
    for i, c in enumerate(SIGNS):
        out[ord(c)] = 7 + i
    return out


WIDTH = KINDS * KINDS + 8


def repeats(first: np.ndarray, last: np.ndarray, codes: np.ndarray, of: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: pieces, share of different ones, share of the most frequent one."""
    n = np.bincount(of, minlength=m)
    keys, one, times = np.unique(textkit.mix64(textkit.hashes(codes, first, last) + of.astype(np.uint64) * textkit.BASE), return_index=True, return_counts=True)
    text = of[one]
    most = np.zeros(m)
    np.maximum.at(most, text, times)
    return n, np.bincount(text, minlength=m) / np.maximum(n, 1), most / np.maximum(n, 1)


def features(texts: list[str]) -> np.ndarray:
    """A row a text: shares of pairs of neighbouring signs' classes, and how long, repetitive and wordy it is. Empty texts: zeros but for a flag."""
    codes, starts = textkit.joined(texts)
    m, kind = len(texts), classes()[codes].astype(np.int64)
    ends = starts[1:] - 1
    text = np.repeat(np.arange(m), np.diff(starts))
    pairs = kind[:-1] * KINDS + kind[1:]
    inside = np.ones(len(pairs), bool)
    inside[ends[ends < len(pairs)]] = False
    inside[np.maximum(ends - 1, 0)[ends > 0]] = False
    flat = np.bincount(text[:-1][inside] * KINDS**2 + pairs[inside], minlength=m * KINDS**2).reshape(m, KINDS**2)
    length = ends - starts[:-1]
    words = textkit.runs((kind != 3) & (kind != 4) & (kind != 5))
    lines = textkit.runs(codes != 10)
    w = repeats(*words, codes, np.searchsorted(starts, words[0], "right") - 1, m)
    k = repeats(*lines, codes, np.searchsorted(starts, lines[0], "right") - 1, m)
    size = length / np.maximum(w[0], 1)
    more = np.stack([length == 0, np.log1p(length) / 10, w[1], w[2], k[1], k[2], np.minimum(size, 50) / 10, np.minimum(length / np.maximum(k[0], 1), 5000) / 1000], 1)
    return np.concatenate([np.sqrt(flat / np.maximum(length, 1)[:, None]), more], 1).astype(np.float32)


def rows_of(docs: DataFrame) -> np.ndarray:
    """Features of a bounded set of documents, on the driver, in an order that does not depend on partitions."""

    def look(batches):
        for _, texts, _ in textkit.chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in features(texts)], pa.binary())], names=["row"])

    found = sorted(r["row"] for r in docs.select("text").mapInArrow(look, "row binary").collect())
    return np.frombuffer(b"".join(bytes(r) for r in found), np.float32).reshape(-1, WIDTH).astype(np.float64)


def scaled(good: np.ndarray, any_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    mean, std = any_.mean(0), any_.std(0) + 1e-2
    return np.clip((good - mean) / std, -8, 8), np.clip((any_ - mean) / std, -8, 8), mean, std


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risks(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with the logistic loss: pi R+(P), and R-(U) - pi R-(P), which an estimate may take below zero."""
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By each score of P and of U, the slope of the risk; where its second part is below zero, that part's alone, turned back."""
    positive, cu = -prior * sigmoid(-gp) / len(gp), sigmoid(gu) / len(gu)
    negative = -prior * sigmoid(gp) / len(gp)
    if risks(gp, gu, prior)[1] >= 0:
        return positive + negative, cu
    return -negative, -cu


def descend(p: np.ndarray, u: np.ndarray, slope) -> tuple[np.ndarray, float]:
    """Weights and bias that lower a risk whose slopes by scores are slope(gp, gu)."""
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, ROUNDS + 1):
        cp, cu = slope(p @ w + b, u @ w + b)
        grad = np.append(p.T @ cp + u.T @ cu, cp.sum() + cu.sum())
        grad[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def least_ratio(gp: np.ndarray, gu: np.ndarray) -> float:
    """The least ratio of U's part to P's part above a score, over the scores that LEAST_TAIL of P or more are above.

    Each ratio counts with its standard error on top, or the least of many would be too low by chance.
    """
    found = []
    for c in np.quantile(gp, np.linspace(0, 1 - LEAST_TAIL, 41)):
        n, m = int((gp >= c).sum()), int((gu >= c).sum())
        p, u = n / len(gp), m / len(gu)
        found.append(u / p * (1 + np.sqrt((1 - p) / n + (1 - u) / max(m, 1))))
    return float(min(found))


def class_prior(good: np.ndarray, any_: np.ndarray) -> float:
    """The estimated share of good texts among any: P is told from U on one half, the ratio taken on the other, both ways; the mean."""
    if len(good) < 20 or len(any_) < 20:
        return PRIOR
    p, u, *_ = scaled(good, any_)
    found = []
    for k in (0, 1):
        w, b = descend(p[k::2], u[k::2], lambda gp, gu: (-0.5 * sigmoid(-gp) / len(gp), 0.5 * sigmoid(gu) / len(gu)))
        found.append(least_ratio(p[1 - k :: 2] @ w + b, u[1 - k :: 2] @ w + b))
    return min(0.98, max(0.02, float(np.mean(found))))


def fit(good: np.ndarray, any_: np.ndarray, prior: float) -> np.ndarray:
    """Weights for raw features and, last, the bias."""
    if not len(good) or not len(any_):
        out = np.zeros(WIDTH + 1)
        out[-1] = np.log(prior / (1 - prior))
        return out
    p, u, mean, std = scaled(good, any_)
    w, b = descend(p, u, lambda gp, gu: slopes(gp, gu, prior))
    return np.concatenate([w / std, mean, std, [b]])


def logits(rows: np.ndarray, model: np.ndarray) -> np.ndarray:
    if len(model) == WIDTH + 1:
        return rows @ model[:-1] + model[-1]
    w, mean, std = model[:WIDTH], model[WIDTH : 2 * WIDTH], model[2 * WIDTH : 3 * WIDTH]
    return np.clip((rows - mean) / std, -8, 8) @ (w * std) + model[-1]


def drawn(df: DataFrame, n: int, rows: int) -> DataFrame:
    """About n of df's rows, by a hash of doc_id."""
    return df.where((F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 30)) / float(1 << 30)) < min(1.0, n / max(rows, 1)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """A model from documents (doc_id, text) and the labels (doc_id, quality) of those that may be trusted, quality 1; others tell nothing.

    Two bounded samples are learned from, of about `sample` rows each. Without a trusted text the score is PRIOR for every text.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = drawn(trusted, sample, trusted.count())
    good = rows_of(docs.join(F.broadcast(ids), "doc_id", "left_semi"))  # about `sample` ids
    any_ = rows_of(drawn(docs, sample, docs.count()))
    return fit(good, any_, class_prior(good, any_))


def predict(docs: DataFrame, model: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns in carry) with score (that the text is good) and predicted. Null counts as empty; empty texts have scores too."""
    docs = docs.drop("score", "predicted")
    carry = docs.columns if carry is None else carry

    def look(batches):
        for rows, texts, _ in textkit.chunks(batches):
            score = sigmoid(logits(features(texts).astype(np.float64), model))
            yield from rows.select(carry).append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= 0.5).astype(np.int32))).to_batches()

    return docs.mapInArrow(look, T.StructType([*docs.select(*carry).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    labels = read(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "quality")
    return predict(docs, learn(docs, labels), ["doc_id", "held_out"])
