"""What the near-duplicate join keeps on disk, and how it reads texts again when more sets than a broadcast takes are compared."""

import random
from pathlib import Path

import pytest

from srcgraph.llm import near, staging


def changed(rng: random.Random, words: list[str], times: int) -> str:
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def test_staged_tables_are_smaller_than_the_texts(spark, monkeypatch):
    rng, there, most = random.Random(1), {}, []
    stage, drop = near.stage, near.drop

    def staged(*a, **b):
        out = stage(*a, **b)
        there[out._staged_at] = sum(f.stat().st_size for f in Path(out._staged_at).glob("*.parquet"))
        most.append(sum(there.values()))
        return out

    def dropped(*tables):
        drop(*tables)
        for t in tables:
            there.pop(getattr(t, "_staged_at", None), None)

    monkeypatch.setattr(near, "stage", staged)
    monkeypatch.setattr(near, "drop", dropped)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(2000)] for _ in range(120)]
    rows = [(g, " ".join(base)) for g, base in enumerate(bases)] + [(len(bases) + g, changed(rng, bases[g], 10)) for g in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {i: i % len(bases) for i, _ in rows}
    assert max(most) < sum(len(t) for _, t in rows) / 2


@pytest.mark.parametrize("limit, scans", [(500_000, 8), (7, 100), (7, 1)])
def test_texts_are_read_again_for_any_number_of_sets(spark, monkeypatch, limit, scans):
    monkeypatch.setattr(near, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(staging, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(near, "SCANS", scans)
    rng, rows = random.Random(2), []
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(80)]
        # a text under two numbers, one that repeats its row, one without a number, and two that are nearly the same
        rows += [(10 * g, " ".join(base), g), (10 * g + 1, " ".join(base), g), (10 * g + 1, " ".join(base), g), (None, changed(rng, base, 1), g), (10 * g + 2, changed(rng, base, 1), g), (10 * g + 3, changed(rng, base, 1).upper(), g)]
    rows += [(1000, None, None), (1001, " \n", None), (1002, "two words", 12), (1003, "Two  words", 12)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in near.near_groups(docs).collect() if r["doc_id"] is not None)
    least = {}
    for i, _, g in rows:
        if g is not None and i is not None:
            least[g] = min(i, least.get(g, i))
    assert got == sorted((False, i, i if g is None else least[g]) for i, _, g in rows if i is not None)
    assert sorted(r["component_id"] for r in near.near_groups(docs).where("doc_id is null").collect()) == [10 * g for g in range(12)]
