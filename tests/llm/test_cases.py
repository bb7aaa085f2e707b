"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for all operators and stages; paths that only large tables take."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.llm import dedup, langid, licenses, lm, mixing, near, packing, quality, sharding, vectors

LONG = " ".join(f"w{i % 7919}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a"), (1, None, "en", "a"), (None, "some text of no document number", None, None), (None, "some text of no document number", "fr", "a"), (2, "", "en", "b"), (3, "  \n", None, "b"),
    (4, "the same text here", "en", "a"), (5, "the  same text here", "en", "a"), (4, "another text under a used number", "fr", "a"), (6, "the same text here", "en", None), (7, LONG, "en", "a"), (8, LONG + " end", "en", "b"),
    (9, "Kelvin and İstanbul MIT LICENSE, released under the MIT license", "fr", "b"), (10, "...mit license", "fr", "b"),
]
#: Names that operators use for columns of their own.
CLASHING = ("_id", "_mark", "_own", "_kept", "_stays", "_times", "_order", "_pass", "_row", "_takes", "_at", "_n", "_v", "_b", "_in", "_from", "position", "size", "score", "shard", "node", "root", "mark", "kind", "w", "hits")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


MODEL = langid.fit({"en": ["the same text here and there"] * 5, "fr": ["le texte et la maison"] * 5})
ALL = {
    "language ID": lambda d: langid.predict(d, MODEL), "quality": lambda d: quality.predict(d, quality.learn(d, d.sparkSession.createDataFrame([(4, 1), (5, 1), (7, 0)], "doc_id long, quality int"))), "packing": packing.pack,
    "sharding": sharding.shard, "mixing": mixing.mix, "licenses": licenses.scan, "exact": dedup.exact_dedup, "lm": lm.lm_scores, "near": near.near_groups,
}
STAGES = {"language ID": langid.langid_stage, "exact": dedup.dedup_stage, "near": near.near_stage, "mixing": mixing.mix_stage}


@pytest.mark.parametrize("name", ALL)
def test_every_row_has_a_result(docs, name):
    got = [r["doc_id"] for r in ALL[name](docs).collect()]
    want = [r[0] for r in ROWS]
    if name == "packing":
        assert {*got} == {*want}
    else:
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ALL)
def test_no_documents(docs, name):
    f = ALL[name]
    if name == "quality":
        model = quality.learn(docs, docs.sparkSession.createDataFrame([(4, 1), (5, 1), (7, 0)], "doc_id long, quality int"))
        f = lambda d: quality.predict(d, model)
    assert f(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_take_clashing_names(docs, name):
    got = STAGES[name](docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r["_kept"] == CLASHING.index("_kept") and r["position"] == CLASHING.index("position") for r in rows) and rows
    assert STAGES[name](docs.limit(0)).count() == 0


def test_no_language_is_known(docs):
    got = langid.langid_stage(docs.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, t, *_ in ROWS if t and t.strip())


def test_license_words_of_odd_texts(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs).where("doc_id in (9, 10)").collect()}
    assert (got[9]["n_base"], got[9]["first_word"], got[9]["last_word"], got[9]["base_labels"]) == (2, 3, 8, "mit")
    assert (got[10]["n_words"], got[10]["first_word"]) == (2, 0)


def test_license_join_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [*{w for _, t in licenses.TEMPLATES for w in t.split()}, "alpha", "beta", "gamma"]
    texts = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(150))]
        if i % 2:
            t = rng.choice(licenses.TEMPLATES)[1].split()
            if i % 3 == 0:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        texts.append((i, rng.choice((" ", ", ", "\n")).join(words)))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        w = re.findall(r"[a-z0-9]+", text)
        labels, share = set(), 0.0
        for start in range(0, max(len(w) - (licenses.WINDOW - licenses.STEP), 1), licenses.STEP):
            own = set(w[start : start + licenses.WINDOW])
            for label, t in licenses.TEMPLATES:
                t = set(t.split())
                if len(own & t) >= licenses.need(len(t)):
                    labels.add(label)
                    share = max(share, len(own & t) / len(t))
        spans = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in licenses.PHRASES}
        found = sorted(k for v in spans.values() for k in v)
        labels |= {label for label, v in spans.items() if v}
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["labels"]) == (len(w), len(found), ",".join(sorted(labels)))
        assert abs(got[i]["score"] - (1.0 if found else share)) < 1e-12
        assert (got[i]["first_word"], got[i]["last_word"]) == ((found[0], found[-1]) if found else (None, None))


def copies(seed: int, groups: int, most: int) -> list[tuple[int, str]]:
    """Groups of texts with up to most words changed, and a passage that all share."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(25)]
    for g in range(groups):
        base = [f"g{g}x{rng.randrange(400)}" for _ in range(60 + 10 * (g % 4))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(most + 1)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(passage * (g % 2) + words)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"MET": 3, "BLOCK": 4, "CALL_ROWS": 10, "CALL_SHINGLES": 300, "FREQUENT": 2}, {"MET": 2, "BLOCK": 2, "TILE_SHINGLES": 150, "CALL_BITMAPS": 500, "MOST_FREQUENT": 5}])
def test_near_groups_in_tiles_of_any_size(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near, name, value)
    rows = copies(len(limits), 5, 4)
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(root)
        for i in sets:
            for j in sets:
                if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == root and len({*root.values()}) > 5


def test_vectors_of_no_table_and_odd_columns(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.001], 0), (2, None, 0), (3, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("bucket", F.lit(1)).withColumn("node", F.lit(2))
    assert vectors.near_vectors(df).count() == len(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_non_negative_risk_and_its_slopes():
    rng = np.random.default_rng(2)
    for shift in (0.0, 3.0):  # the second part above, and below, zero
        gp, gu, pi = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 9), 0.6
        loss = lambda g, y: np.log1p(np.exp(-y * g))
        first, second = pi * np.mean([loss(g, 1) for g in gp]), np.mean([loss(g, -1) for g in gu]) - pi * np.mean([loss(g, -1) for g in gp])
        assert np.allclose(quality.risks(gp, gu, pi), (first, second))
        assert (second >= 0) == (shift == 0)
        part = (lambda x, y: sum(quality.risks(x, y, pi))) if second >= 0 else (lambda x, y: -quality.risks(x, y, pi)[1])
        sp, su = quality.slopes(gp, gu, pi)
        for k in range(7):
            d = np.eye(7)[k] * 1e-6
            assert np.isclose(sp[k], (part(gp + d, gu) - part(gp - d, gu)) / 2e-6, atol=1e-8)
        for k in range(9):
            d = np.eye(9)[k] * 1e-6
            assert np.isclose(su[k], (part(gp, gu + d) - part(gp, gu - d)) / 2e-6, atol=1e-8)


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.7):
        good = rng.normal(2, 1, (1500, 4))
        any_ = np.where(rng.random((3000, 1)) < share, rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (3000, 4)))
        assert abs(quality.class_prior(good, any_) - share) < 0.06


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r["doc_id"]: r for r in quality.op2_quality(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(scores[i]["score"], q) for i, q in labels if scores[i]["held_out"] and q is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in held]) > 0.9
