"""Near dedup where ids are null or repeat over unlike texts."""

from __future__ import annotations

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(name):
    return " ".join(f"{name}{i}" for i in range(40))


def test_null_and_repeated_ids(spark):
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (1, text("d")), (1, text("e")), (2, text("e")), (3, text("f")), (None, text("f")), (None, ""), (None, " "), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (1, text("d")), (1, text("e")), (3, text("f")), (None, ""), (None, " "), (4, None)]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
