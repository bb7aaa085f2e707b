"""The pipeline over a small corpus, stage by stage, against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from srcgraph.llm import packing

WORDS = {"en": "the and house garden with from they were what over under after river stone light small great water".split(), "fr": "le la maison jardin avec depuis nous avons quoi sur sous apres riviere pierre lumiere petit grand eau".split()}


def text(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(("", "", "s")) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(9), []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        rows.append((i, text(rng, lang), lang, ("web", "book", None)[i % 3]))
    for i in range(0, 40, 4):  # exact copies but for white space, near copies, and repeated rows
        rows.append((1000 + i, rows[i][1].replace(" ", "  ", 3), rows[i][2], "web"))
        rows.append((2000 + i, rows[i + 1][1] + " end", rows[i + 1][2], "book"))
        rows.append(rows[i + 2])
    rows += [(3000, None, "en", "web"), (3001, "", None, "web"), (3002, "12 34 !!", "en", "web"), (None, text(rng, "en"), None, "web"), (None, text(rng, "fr"), "fr", None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_each_stage_and_the_whole(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
        assert i == 4 or tables[-1].columns == docs.columns
    before, known, unlike, apart, mixed = (Counter(rows_of(t)) for t in tables[:5])
    # language ID: what has no letters goes, all else is clean and stays
    assert known == Counter({r: n for r, n in before.items() if r[1] and re.search("[a-z]", r[1])})
    # exact dedup: the longest of equal texts, then the least doc_id
    best: dict[str, tuple] = {}
    for r in known:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        best[key] = min(best.get(key, r), r, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
    assert unlike == Counter(best.values())
    # near-duplicates: one row of each component, that of the least doc_id
    own = list(unlike)
    sets = [shingles(r[1]) for r in own]
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    kept = {min((r for r, x in zip(own, root) if x == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(root)}
    assert apart == Counter(kept)
    # mixing: whole documents, none more than three times, words near the targets of the sources
    assert set(mixed) <= set(apart) and max(mixed.values()) <= 3
    size = lambda r: len(r[1].split())
    total = {s: sum(size(r) for r in apart if r[3] == s) for s in ("book", "web", None)}
    level, target, free = {"book": 5, "web": 2, None: 1}, {}, set(total)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * level[s] / sum(level[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 3 * total[s] for s in full}
        free -= full
    for s in total:
        assert abs(sum(size(r) * n for r, n in mixed.items() if r[3] == s) - target[s]) <= max(size(r) for r in apart) + 1
    # packing: every token of every row, once, in gapless sequences
    pieces = tables[5].collect()
    tokens = packing.Tokens()
    want = Counter()
    for r, n in mixed.items():
        want[r[0]] += n * (len(tokens.encode([r[1]])[0]) + 1)
    got = Counter()
    places: dict[int, list] = {}
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == want
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    one = next(iter(mixed))
    ids = [*tokens.encode([one[1]])[0].tolist(), 2]
    assert any(p["doc_id"] == one[0] and p["ids_crc32"] == zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids)) for p in pieces)
    whole = corpus_pipeline.run(spark, folder)
    assert sum(r["length"] for r in whole.collect()) == sum(want.values())
