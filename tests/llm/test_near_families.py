"""Near duplicates in large families whose members are alike to just below the bound."""

from __future__ import annotations

import random

import pyarrow as pa

from ledgerfold.llm import neardup


def family(seed, n=300, length=600, edits=10, own=6):
    """Pairs of texts at a likeness of about 0.81; all others of the family are at about 0.71 to 0.79."""
    rng = random.Random(seed)
    base = [f"w{seed}x{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for i in range(n):
        places = rng.sample(range(0, length, 6), edits + own)
        for j, at in enumerate((places[:edits], places[own:])):
            t = list(base)
            for p in at:
                t[p] = f"e{seed}.{i}.{p}" if p in places[own:edits] else f"e{seed}.{i}.{p}.{j}"
            out.append(" ".join(t))
    return out


def exact(texts, k=5):
    ids: dict[tuple, int] = {}
    sets = [{ids.setdefault(x, len(ids)) for x in zip(*(t.split()[i:] for i in range(k)), strict=False)} for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def test_links_hidden_in_a_crowd(spark):
    texts = family(1) + family(2)
    want = exact(texts[:600]) + [600 + i for i in exact(texts[600:])]
    assert len(set(want)) > 400
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def rows_of_a_key(n):
    cols = [[7] * n + [9], [i // 4 for i in range(n)] + [0], list(range(n + 1)), [10] * (n + 1), [0] * (n + 1), [-1] * (n + 1)]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=neardup._MET)


def test_met_pairs_across_batches():
    n = 40
    whole = rows_of_a_key(n)
    for most in (1000, 41, 40):
        got = {p for b in neardup._met(80, most)([whole.slice(i, 3) for i in range(0, n + 1, 3)]) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if i // 4 != j // 4}
    for step in (3, 41):
        back = [r for b in neardup._met(80, 39)([whole.slice(i, step) for i in range(0, n + 1, step)]) for r in b.to_pylist()]
        assert all(r["a"] is None and r["key"] == 7 for r in back) and sorted(r["short"] for r in back) == list(range(n))


def test_crowded_shingles_meet_in_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([5, 6, 7]), rng.randrange(20), short, 10, rng.randrange(3), -1) for short in range(400)]
    df = spark.createDataFrame(rows, neardup._MET_TYPES)
    pairs = lambda most: sorted(map(tuple, neardup._all_met(df, 80, most).distinct().collect()))
    want = pairs(10_000)
    assert len(want) > 10_000 and pairs(60) == pairs(9) == want


def test_families_in_crowds(spark, monkeypatch):
    texts = family(3, n=60) + ["one line that is everywhere " + w for w in "abcdefghij"] * 3
    want = {i: c for i, c in enumerate(exact(texts))}
    monkeypatch.setattr(neardup, "CROWD", 4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
