"""The pipeline's stages against brute force, with null and repeated doc_ids and repeated rows."""

import hashlib
import math
import re
from collections import Counter

from srcgraph.llm import dedup, mixing, near

SCHEMA = "doc_id long, text string"


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_dedup_stage_decides_by_row(spark):
    rows = [(None, "x"), (None, "x"), (None, "other"), (3, "y"), (7, "y"), (7, "clean"), (7, "clean"), (8, "z"), (8, "z \n"), (9, None), (2, ""), (4, "a b"), (4, "c"), (None, "y"), (5, "only")]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(bare(r[1]), []).append(r)
    want = Counter(min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for own in groups.values())
    assert rows_of(dedup.dedup_stage(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_near_stage_decides_by_row(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    a, b, c, d = map(words, "abcd")
    rows = [(None, a), (None, a + " end"), (None, b), (3, c), (7, c + " end"), (7, "clean text of its own"), (7, d), (9, d + " end"), (7, "other words here"), (None, c + " tail"), (5, ""), (5, None), (8, "same row"), (8, "same row")]
    got = rows_of(near.near_stage(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    first = {r for r in got if r[1] in (a, a + " end")}
    assert len(first) == 1
    assert got == Counter([*first, (None, b), (3, c), (7, "clean text of its own"), (7, d), (7, "other words here"), (5, ""), (5, None), (8, "same row")])


def test_mix_stage_places_each_pass(spark):
    rows = [(i, "w " * 4, "a") for i in range(6)] + [(i, "v " * 5, "b") for i in range(100, 180)] + [(None, "n n", "b"), (None, "m m m", "a"), (5, "u u", "b"), (200, "same one", "c"), (200, "same one", "c"), (201, "t " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {r: len(r[1].split()) for r in rows}
    facts = {(r["doc_id"], r["size"]): r for r in mixing.mix(docs).collect()}
    want: list[tuple] = []
    for j, s in enumerate(sources):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), size[r]))
        total, tilt = sum(size[r] for r in own), mixing.TILTS[j % 3]
        target = next(facts[r[0], size[r]]["target"] for r in own)
        at = 0
        for p in range(3):
            for r in own:
                took = max(0, min(int(target) - at, size[r]))
                if 2 * took >= size[r]:
                    y = at / target
                    want.append((y if tilt == 0 else (1 + tilt - math.sqrt((1 + tilt) ** 2 - 4 * tilt * y)) / (2 * tilt), r))
                at += size[r]
        assert at == 3 * total
    got = [tuple(r) for r in mixing.mix_stage(docs).collect()]
    assert Counter(got) == Counter(r for _, r in want)
    assert [g[2] for g in got] == [r[2] for _, r in sorted(want, key=lambda x: (x[0], hashlib.md5(str("" if x[1][0] is None else x[1][0]).encode()).hexdigest()))]
    places = [i for i, g in enumerate(got) if g[2] == "a"]
    assert max(places) > 0.7 * len(got)
