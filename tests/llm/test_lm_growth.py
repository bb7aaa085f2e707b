"""What op9 sends and holds for a word, over few parts and over many."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from srcgraph.llm import lm


def test_answers_do_not_grow_with_parts(spark, monkeypatch):
    rng, kept = random.Random(5), []
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(300))) for i in range(1200)]
    docs, plain = spark.createDataFrame(rows, "doc_id long, text string"), lm.stage

    def counted(df, name, *args, **more):
        out = plain(df, name, *args, **more)
        if name == "lm-owned":
            kept.append(out.agg(F.sum(F.length("blob"))).first()[0])
        return out

    monkeypatch.setattr(lm, "stage", counted)
    for parts in (8, 64):
        assert lm.lm_scores(docs.repartition(parts)).count() == len(rows)
    assert kept[1] < 1.6 * kept[0]


def test_senders_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 40)
    monkeypatch.setattr(lm, "GIVEN", 100)
    monkeypatch.setattr(lm.textkit.chunks, "__defaults__", ("text", 50))
    rng = random.Random(6)
    rows = [(i % 70 if i % 9 else None, " ".join(f"{'X' if rng.random() < 0.5 else 'x'}{int(rng.paretovariate(0.5))}" for _ in range(rng.choice((0, 1, 3, 25, 400))))) for i in range(120)]
    one, two = {}, {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for _, t in rows]
    for w in words:
        for v, x in zip([None, *w], w):
            one[x] = one.get(x, 0) + 1
            two[v, x] = two.get((v, x), 0) + 1
    one[None], total = sum(bool(w) for w in words), sum(map(len, words))
    want = []
    for (i, _), w in zip(rows, words):
        s = sum(np.log(two[p] / one[p[0]]) if two[p] >= 2 else np.log(0.4 * one[p[1]] / total) for p in zip([None, *w], w))
        want.append((i is None, i or 0, len(w), sum(two[p] >= 2 for p in zip([None, *w], w)), round(float(s), 6)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_seen"], round(r["log_score"], 6)) for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert [r[:4] for r in sorted(got)] == [r[:4] for r in sorted(want)] and np.allclose([r[4] for r in sorted(got)], [r[4] for r in sorted(want)], atol=1e-5)


def test_packed_keys_and_counts():
    rng = np.random.default_rng(1)
    for n in (1, 5, 100_000):
        keys = np.unique(rng.integers(0, 2**58, n, dtype=np.uint64) + np.uint64(3 << 58))
        counts = rng.integers(1, 1000, len(keys))
        blob = lm.pack_keys(keys) + lm.pack_counts(counts)
        back, end = lm.unpack_keys(blob)
        assert (back == keys).all() and (lm.unpack_counts(blob, len(back), end) == counts).all()
