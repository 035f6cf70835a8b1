"""Ways that small fixtures do not take: large joins, long texts, crowds, parts within parts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import decontam, fingerprint, linedup, mixing, neardup, secrets


def by(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def leaked(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 9, 10, 14, 30])))) for i in range(40)] + [(90, None), (91, ""), (None, "w1 w2 w3")]
    docs = []
    for i in range(120):
        t = rng.choices(words, k=rng.randrange(0, 200))
        if i % 3 == 0:
            t[10:10] = rng.choice(items[:40])[1].upper().split()
        docs.append((i % 100, " ".join(t)))
    docs += [(None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (5, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_contamination_without_a_broadcast(leaked):
    docs, items = leaked
    small = by(decontam.contamination(docs, items))
    assert small == by(decontam.contamination(docs, items, broadcast_shingles=0)) and sum(r[-1] for r in small) > 30


def test_contamination_of_a_long_text(spark):
    """Time grows with the length of a text, not with its square."""
    items = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(30)))], "item_id long, text string")
    item = " ".join(f"x{i}" for i in range(30))
    spent = {}
    for n in (50_000, 50_000, 400_000):
        text = " ".join(f"v{i % 977}" for i in range(n)) + " " + item
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = decontam.contamination(docs, items).first()
        spent[n] = time.time() - began
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n + 30, 30, 1)
    assert spent[400_000] < 8 * spent[50_000] + 5


def test_weak_parts_in_long_strict_spans():
    text = "user: bob token=0123456789abcdef01234567.0123456789abcdef01234567.0123456789abcdef01234567.0123456789abcdef01234567.kQ9vT2mXb7LpZ4sWc1RfY8nHd"
    strict = secrets.strict_spans(text)
    assert [s.kind for s in secrets.weak_spans(text, strict)] == ["identifier"]
    rng = random.Random(6)
    for _ in range(300):
        strict = [secrets.Span("hex", a, a + rng.randrange(1, 60)) for a in (rng.randrange(300) for _ in range(rng.randrange(12)))]
        weak = [secrets.Span("identifier", m, m + rng.randrange(1, 20)) for m in (rng.randrange(300) for _ in range(4))]
        free = secrets.uncovered(strict)
        assert [free(w) for w in weak] == [not any(s.start < w.end and w.start < s.end for s in strict) for w in weak]


def test_mixture_of_equal_rows(spark):
    rows = [(None, "a few words here", "s")] * 3000 + [(i, "five words are in this", "s") for i in range(500)] + [(7, "one two", "t")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixture(docs).collect()
    assert len(found) == len(rows)
    for source in "st":
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_fingerprints_of_named_documents(spark):
    rows = [(f"doc-{i:03}", f"text {i} of some words that go on and on") for i in range(50)] + [(None, "no name"), (None, "no name"), ("doc-001", "told again")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(len(r["fingerprint"]) == 256 for r in got)


def test_near_duplicates_of_rows_without_ids(spark):
    text = lambda i, k: " ".join(f"w{i}.{j}" if j != k else f"z{k}" for j in range(60))
    rows = [(None, text(i, k)) for i in range(60) for k in (0, 0, 59)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), keyed=True).collect()
    assert len(got) == len(rows) and len({bytes(r["group"]) for r in got}) == 60 and all(r["component_id"] is None for r in got)


def test_passages_in_running_text(spark):
    """A passage of 51 words goes from all documents but the first, wherever it stands in their lines; its ends may stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9)))
    for form in (" ", "\n", "short lines"):
        passage = [word() for _ in range(51)]
        joined = " ".join(passage) if form == " " else "\n".join(" ".join(passage[i : i + 2]) for i in range(0, 51, 2)) if form != "\n" else "\n".join(" ".join(passage[i : i + 17]) for i in range(0, 51, 17))
        rows = []
        for i in range(12):
            before, after = (" ".join(word() for _ in range(rng.randrange(0, 90))) for _ in range(2))
            rows.append((i, before + rng.choice([" ", "\n", ". "]) + joined + rng.choice([" ", "\n", ", "]) + after))
        got = {r["doc_id"]: r for r in linedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0]["text"] == rows[0][1] and got[0]["n_removed"] == 0
        for i, text in rows[1:]:
            left = sum(w in got[i]["text"].split() for w in passage)
            assert got[i]["n_removed"] >= 4 and left <= 16, (form, i, left, got[i]["text"])
            own = [w for w in text.replace(joined, "").split() if w.strip(".,")]
            assert all(w in got[i]["text"] for w in own if w not in passage)


def test_short_repeats_stay(spark):
    rows = [(i, f"own beginning {i} of this text\nAll rights reserved.\nPage one\nof two\nown end {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["text"] for r in linedup.without_repeats(docs).orderBy("doc_id").collect()] == [t for _, t in rows]
    assert sum(r["n_removed"] for r in linedup.without_repeats(docs, least_words=0).collect()) == 12
    assert docs.select(F.count("*")).first()[0] == 5
