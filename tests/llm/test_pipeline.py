"""Each stage of the pipeline against plain Python on the rows it was given."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import quality
from ledgerfold.llm.store import saved

from plain_line_dedup import plain_cut, plain_lines, plain_windows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are absent")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def by_quality(spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = Counter(r["doc_id"] for r in quality.quality(docs, model).where("score >= 0.3").collect())
    return [r for r in rows(docs) if good[r[0]]]


def by_lines(spark, docs):
    every, out = rows(docs), []
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    texts = {(r[0], r[1]): plain_lines(r[1]) for r in every}
    first = {}
    for key in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x])):
        for i, held in plain_windows(texts[key]):
            first.setdefault(held, (key, i))
    for r in every:
        key = r[:2]
        text, removed = plain_cut(r[1], texts[key], [i for i, held in plain_windows(texts[key]) if first[held] != (key, i)])
        if not removed or text:
            out.append((r[0], text, r[2], r[3], len(text) if removed else r[4]))
    return sorted(out, key=repr)


def by_groups(spark, docs):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    every = rows(docs)
    sets = [shingles(r[1]) for r in every]
    parent = list(range(len(every)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                parent[max(find(i), find(j), key=lambda k: every[k][0])] = min(find(i), find(j), key=lambda k: every[k][0])
    return [r for i, r in enumerate(every) if find(i) == i]


def by_benchmark(spark, docs):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [r for r in rows(docs) if not hit(split(r[1]))]


NAIVE = [by_quality, by_lines, by_groups, by_benchmark]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for (name, stage), naive in zip(corpus_pipeline.STAGES, NAIVE, strict=False):
        out = saved(stage(spark, docs, DATA), "stage")
        assert out.columns == COLUMNS, name
        assert rows(out) == naive(spark, docs), name
        docs = out
    mixed = corpus_pipeline.mix(spark, docs, DATA)
    taken = Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in mixed.collect())
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    words = Counter()
    for (_, source, n), k in taken.items():
        assert k <= 2
        words[source] += n * k
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    goal, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while over := {s for s in free if left * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s]}:
        goal |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    goal |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    most = max(r["n_chars"] for r in docs.collect())
    assert all(abs(words[s] - goal[s]) <= most for s in sizes)


def test_repeats_nulls_and_an_empty_table(spark, odd, nothing, tmp_path):
    for name, df in (("odd", odd.select(*COLUMNS)), ("none", nothing.select(*COLUMNS))):
        at = tmp_path / name
        df.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([(1, "words in it")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert bool(out) == (name == "odd")
        assert all(r["doc_id"] not in (5, 6) for r in out)
    # Of the near copies and repeated rows one row of one document stays.
    twice = odd.select(*COLUMNS).where("doc_id in (4, 5, 6) or doc_id is null")
    kept = corpus_pipeline.near_dedup(spark, twice.unionByName(twice), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 4), (False, 5), (True, None)]
