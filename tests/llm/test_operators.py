"""The operators on small rows with nulls, empty texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from srcgraph.llm import components, dedup, langid, licenses, lm, mixing, near, packing, quality, sharding, vectors

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello, World! don't  stop 12 + x'll"), (5, "héllo wörld ß 漢字 test"), (6, "Hello,World!  don't stop 12 +x'll"), (7, "word " * 3000), (8, "mit license  Apache\nlicense general public license"), (9, "a b c d e f g h"), (10, "A B c d e f g h"), (11, " x y <|endoftext|> z"), (12, "one"), (13, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 12 else f"s{i % 3}", "en" if i % 2 else "fr", i, 0.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int, score double")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_ids_equal_the_library():
    words = ["a", "don't", "'s", "  ", "\n\n ", "12", "é", "漢", "!?", "'", "''ll", " 've", " ", "x" * 30, "I'M", "3rd", "\t"]
    rng = random.Random(1)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(400)]
    tokens = packing.Tokens()
    want = [e.ids for e in tokens.whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.encode(texts)] == want


def test_packing(docs):
    rows = packing.pack(docs, length=64).collect()
    tokens = packing.Tokens()
    for i, t in ODD:
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = np.append(tokens.encode([t or ""])[0], 2).astype("<u4")
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 64


def test_fit_uses_each_piece_once():
    rng = np.random.default_rng(0)
    histogram = np.zeros(1025, np.int64)
    np.add.at(histogram, rng.integers(1, 1025, 3000), 1)
    plan = packing.fit(histogram)
    used = np.zeros(1025, np.int64)
    for lengths, k in plan:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += k
    assert (used == histogram).all()
    rooms: list[int] = []  # first fit decreasing, piece by piece
    for n in np.repeat(np.arange(1025), histogram)[::-1].tolist():
        i = next((i for i, r in enumerate(rooms) if r >= n), None)
        if i is None:
            rooms.append(1024 - n)
        else:
            rooms[i] -= n
    assert sum(k for _, k in plan) <= 1.01 * len(rooms)


def test_exact_dedup(docs):
    got = by_id(dedup.exact_dedup(docs))
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in ODD}
    for i, t in ODD:
        group = [j for j, _ in ODD if bare[j] == bare[i]]
        keep = min(group, key=lambda j: (-len(dict(ODD)[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(group), keep == i)
        assert got[i]["text_sha256"] == hashlib.sha256(bare[i].encode()).hexdigest()


def test_golomb_round_trip():
    gaps = np.random.default_rng(0).geometric(1e-3, 500).astype(np.uint64)
    for k in (0, 5, 10):
        assert (dedup.unrice(dedup.rice(gaps % np.uint64(60), k), 500, k) == gaps % np.uint64(60)).all()


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(nodes, linked):
    root = {i: i for i in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_groups(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)] for _ in range(4)]
    rows = list(ODD)
    for i in range(24):
        words = list(base[i % 4])
        for _ in range(i // 8):
            words[rng.randrange(60)] = "new" + str(i)
        rows.append((100 + i, " ".join(words)))
    got = by_id(near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = {i: shingles(t) for i, t in rows}
    root = brute_components(list(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    for i, _ in rows:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), root[i])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(1, 41)}) == 1 and got[100] == got[101] != got[1] and len({got[200], got[201], got[202], got[100], got[1]}) == 3


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * 16, 1), (3, [float("nan")] * 16, 1), (4, [1.0] * 16, None)]
    for i in range(120):
        x = rng.standard_normal(16) if i % 4 == 0 else x + 0.03 * rng.standard_normal(16) * (i % 2)
        rows.append((5 + i, [float(v) for v in x], i % 3 // 2))
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = {i: (np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)), k) for i, v, k in rows[5:]}
    linked = lambda a, b: a in unit and b in unit and unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.98
    root = brute_components([r[0] for r in rows], linked)
    for i, *_ in rows:
        n = sum(linked(i, j) for j, *_ in rows if j != i)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, root[i], root[i] == i)


def test_recall_of_hashing():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal((500, 64))
    r -= (r * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for n in (100, 5000, 1_000_000):
        (b, p), (c, q) = vectors.codes(x, *vectors.plan(n, 64)), vectors.codes(y, *vectors.plan(n, 64))
        met = (b == c) | (p == c[:, :, None]).any(2) | (q == b[:, :, None]).any(2)
        assert met.any(1).mean() >= 0.99


def test_sharding(docs):
    a, b = by_id(sharding.shard(docs)), by_id(sharding.shard(docs.repartition(5)))
    assert all(a[i]["shard"] == b[i]["shard"] and a[i]["slot"] == b[i]["slot"] and a[i]["grown_shard"] in (a[i]["shard"], 16) for i in a)
    for s in {r["shard"] for r in a.values()}:
        assert sorted(r["slot"] for r in a.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in a.values())))
    assert all(a[i]["size"] == len((t or "").encode()) + 1 and a[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in ODD)


def test_mixing(docs):
    got = by_id(mixing.mix(docs))
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in ODD}
    assert all(got[i]["size"] == n and 0 <= got[i]["taken"] <= 3 * n for i, n in sizes.items())
    by = {}
    for i, _ in ODD:
        by.setdefault(None if i == 12 else f"s{i % 3}", []).append(i)
    total = sum(sizes.values())
    assert abs(sum(got[own[0]]["target"] for own in by.values()) - total) < 1e-6
    for own in by.values():
        assert sum(got[i]["taken"] for i in own) == int(got[own[0]]["target"] + 1e-9)
    assert mixing.mix_stage(docs).columns == docs.columns


def test_licenses(docs):
    got = by_id(licenses.scan(docs))
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"], got[8]["base_labels"], got[8]["score"]) == (3, 0, 4, "apache,gpl,mit", 1.0)
    assert got[1]["labels"] == "" and got[1]["n_words"] == 0 and got[7]["labels"] == ""


def test_lm_scores(docs):
    got = by_id(lm.lm_scores(docs))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in ODD}
    one, two = {}, {}
    for w in words.values():
        for v, x in zip([None, *w], w):
            one[x] = one.get(x, 0) + 1
            two[v, x] = two.get((v, x), 0) + 1
    one[None], total = sum(bool(w) for w in words.values()), sum(map(len, words.values()))
    for i, w in words.items():
        s = sum(np.log(two[p] / one[p[0]]) if two[p] >= 2 else np.log(0.4 * one[p[1]] / total) for p in zip([None, *w], w))
        assert got[i]["n_words"] == len(w) and abs(got[i]["log_score"] - s) < 1e-6 * max(1, abs(s))


def test_forward_sums_all_segmentations():
    vocab = langid.vocabulary(langid.VOCABULARY)
    p = np.random.default_rng(0).random((vocab.n + 1, 1)) / 100
    p[-1] = 0
    word = np.array([[0x2581, *map(ord, "thing")]], np.uint32)
    pieces = vocab.segments(word)

    def total(i):
        return 1.0 if i == 6 else sum(p[pieces[n - 1][0, i], 0] * total(i + n) for n in range(1, min(6, 6 - i) + 1))

    assert np.isclose(langid.forward(pieces, p)[-1][0, 0] / langid.SCALE**6, total(0))


def test_langid_and_quality(spark, docs):
    model = langid.fit({"en": ["the house and the garden"] * 5, "fr": ["la maison et le jardin"] * 5})
    got = by_id(langid.predict(spark.createDataFrame([(1, "the garden"), (2, "le jardin et la maison"), (3, None), (4, "12 !")], "doc_id long, text string"), model))
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "fr", "und", "und"] and got[3]["score"] == 0
    assert langid.langid_stage(docs).columns == docs.columns
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 0)], "doc_id long, quality int")
    scored = by_id(quality.predict(docs, quality.learn(docs, labels)))
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored.values())


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (dedup.exact_dedup, near.near_groups, lm.lm_scores, packing.pack, sharding.shard, mixing.mix, licenses.scan):
        assert f(none).count() == 0
