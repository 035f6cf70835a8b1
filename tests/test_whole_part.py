"""Entity resolution over all parts, whatever their keys."""

from __future__ import annotations

from ledgerfold.plans import catalog


def test_parts_beyond_the_first_keys(spark, tmp_path):
    rows = [(1, "Brand#11", "SMALL PLATED TIN"), (5001, "Brand#42", "STANDARD POLISHED BRASS"), (5002, "Brand#43", "STANDARD POLISHED BRASS"), (900_000, "Brand#42", "STANDARD POLISHED BRASS")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    one, two, alone = "brand 42 standard polished brass", "brand 43 standard polished brass", "brand 11 small plated tin"
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert [(a, b) for a, b, _ in run("char_ngram_tfidf_pairs")] == [(one, two)]
    assert run("review_split") == [(one, two, "keep")]
    assert {n for n, _ in run("connected_components")} == {one, two, alone}
