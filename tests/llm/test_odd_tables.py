"""Every operator over nulls, empty and very long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import decontam, fingerprint, langid, linedup, mixing, neardup, quality, secrets, toxicity, urlfilter

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 0), (4, 0, 1), (8, 0, 0), (2, None, None), (None, 1, 1)], LABELS)


def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "some words in it"), (None, "a row without an id"), (3, "told twice")], "item_id long, text string")


RUNS = {
    "languages": lambda s, d: langid.languages(d, langid.fit(d, F.col("text"), F.col("lang"), F.col("doc_id"))),
    "fingerprints": lambda s, d: fingerprint.fingerprints(d),
    "secrets": lambda s, d: secrets.digest(secrets.secrets(d)),
    "near": lambda s, d: neardup.near_duplicates(d),
    "mixture": lambda s, d: mixing.mixture(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.fit(d, labels(s))),
    "lines": lambda s, d: linedup.without_repeats(d),
    "quality": lambda s, d: quality.quality(d, quality.fit(d, labels(s))),
    "contamination": lambda s, d: decontam.contamination(d, items(s)),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_each(spark, odd, nothing, name):
    assert len(RUNS[name](spark, odd).collect()) == 10
    assert RUNS[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", RUNS)
def test_ids_that_are_texts(spark, odd_named, name):
    if name in ("toxicity", "quality"):
        marks = labels(spark).withColumn("doc_id", F.concat(F.lit("doc "), "doc_id"))
        fit = {"toxicity": lambda: toxicity.toxicity(odd_named, toxicity.fit(odd_named, marks)), "quality": lambda: quality.quality(odd_named, quality.fit(odd_named, marks))}[name]
    else:
        fit = lambda: RUNS[name](spark, odd_named)
    ids = sorted(r["doc_id"] or "" for r in fit().collect())
    assert ids == sorted(r["doc_id"] or "" for r in odd_named.collect())


def test_other_columns_stay(spark, odd):
    cut = linedup.without_repeats(odd)
    own = lambda df, text: sorted((tuple(r[c] for c in odd.columns if c != "text" or text) for r in df.collect()), key=repr)
    assert cut.columns == [*odd.columns, "n_lines", "n_removed"] and own(cut, False) == own(odd, False)
    model = quality.fit(odd, labels(spark))
    scored = quality.scored(odd, model, score_col="quality")
    assert scored.columns == [*odd.columns, "quality"] and own(scored, True) == own(odd, True)
    with pytest.raises(ValueError):
        quality.scored(odd, model)


def test_no_labels_and_no_items(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(odd, toxicity.fit(odd, none)).collect())
    assert all(0 <= r["score"] <= 1 for r in quality.quality(odd, quality.fit(odd, none)).collect())
    assert not any(r["contaminated"] for r in decontam.contamination(odd, items(spark).where("false")).collect())
    model = langid.fit(odd.where("false"), F.col("text"), F.col("lang"), F.col("doc_id"))
    assert {r["lang_pred"] for r in langid.languages(odd, model).collect()} == {"und"}


def test_defined_results(spark, odd):
    by = lambda df, c: {r["doc_id"]: r[c] for r in df.collect()}
    near = neardup.near_duplicates(odd)
    assert by(near, "component_id") == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, None: None, 8: 8, 9: 9}
    assert by(near, "kept")[6] is False and by(near, "n_shingles")[8] == 1
    lang = by(RUNS["languages"](spark, odd), "lang_pred")
    assert lang[1] == lang[2] == lang[8] == "und" and lang[9] == "nl"
    lines = linedup.without_repeats(odd)
    # Both rows of document 5 are one document, which stands first.
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in lines.where("doc_id in (5, 6)").collect()) == [(5, False), (5, False), (6, True)]
    assert by(lines, "text")[1] is None and by(lines, "text")[6] == ""
    hit = by(decontam.contamination(odd, items(spark)), "n_hit")
    assert hit[5] == 6 and hit[None] == 5 and hit[1] == 0
    mix = mixing.mixture(odd)
    assert by(mix, "taken")[2] == 0 and all(r["taken"] <= 2 * r["size"] for r in mix.collect())


def test_urls(spark):
    urls = ["https://WWW.Example.org/en/12?x#y", None, "", "no scheme", "http://example.org", "http://a.example.org/es/", "x://fr.com/fr/a", "x://fr.com/de/", "http://com/fr/", "ftp://org?q", "http://notexample.org/en/1", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(pages, rules).collect()}
    assert got[0] == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("example.org", "", None, "allow") and got[5][2:] == ("example.org/es/", "block")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[9] == ("org", "", None, "allow") and got[10][2:] == ("org/", "allow") and got[11] == ("b:", "//c/d", None, "allow")
    joined = urlfilter.judged(pages, rules, trie_bytes=0)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in joined.collect()} == got
    assert urlfilter.judged(pages.where("false"), rules).count() == 0


def test_rules_that_meet(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/y")], "page_id long, url string")
    rules = [("allow", "org/"), ("block", "org/"), ("block", "b.org/"), ("allow", "B.org/")]
    want = {1: ("org/", "block"), 2: ("B.org/", "allow")}
    run = lambda rules, **how: {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judged(pages, rules, **how).collect()}
    assert run(rules) == run(rules, trie_bytes=0) == want
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, entry string, order int").repartition(4)
    assert run(numbered) == run(numbered, trie_bytes=0) == want
    plain = spark.createDataFrame([*rules, ("allow", None)], "verdict string, entry string")
    assert run(plain) == run(plain, trie_bytes=0) == {1: ("org/", "block"), 2: ("b.org/", "block")}
