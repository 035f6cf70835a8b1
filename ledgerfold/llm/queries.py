"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm import langid
    from ledgerfold.llm.store import fold

    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 3) != 1), F.col("text"), F.col("lang"), F.col("doc_id"))
    found = langid.languages(docs, model)
    return found.select("doc_id", _held_out(3, 1), "lang_pred", "score", F.size("spans").alias("n_spans"))


def _held_out(modulus: int, rest: int):
    from ledgerfold.llm.store import fold

    return F.coalesce(fold(F.col("doc_id"), modulus) == rest, F.lit(False)).alias("held_out")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.fingerprint import fingerprints

    return fingerprints(_read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.secrets import digest, secrets

    return digest(secrets(_read(spark, sf_dir, "documents")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=4)


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.mixing import mixture

    return mixture(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm import toxicity
    from ledgerfold.llm.store import fold

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", _held_out(4, 2), "score", _predicted(), F.size("offending").alias("n_offending"))


def _predicted(bar: float = 0.3):
    return F.when(F.col("score") >= bar, 1).otherwise(0).alias("predicted")


def op7_line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.linedup import without_repeats

    return without_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


#: Verdict and entry of each rule.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.urlfilter import judged

    return judged(_read(spark, sf_dir, "pages"), URL_RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm import quality
    from ledgerfold.llm.store import fold

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return quality.quality(docs, model).select("doc_id", _held_out(5, 0), "score", _predicted())


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.decontam import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_fingerprints": op2_fingerprints,
    "op3_secrets": op3_secrets,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mixture": op5_mixture,
    "op6_toxicity": op6_toxicity,
    "op7_line_repeats": op7_line_repeats,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_contamination": op10_contamination,
}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op7_line_repeats": r"""
WITH rows AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS r FROM documents),
cut AS (SELECT doc_id, r, regexp_extract(line, '^[\x20\x09-\x0D]*') AS lead, regexp_extract_all(line, '(?:[\x{3000}-\x{D7FF}]|[^\x20\x09-\x0D\x{3000}-\x{D7FF}]+)[\x20\x09-\x0D]*') AS parts FROM rows),
worded AS (SELECT doc_id, r, lead, unnest(parts) AS part, unnest(range(len(parts))) AS i, len(parts) AS n FROM cut),
keyed AS (SELECT *, rtrim(part, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS word FROM worded),
wide AS (SELECT doc_id, r, i, n, max({'k': rpad(left(hex(encode(word)), 16), 16, '0'), 'i': i}) OVER (PARTITION BY doc_id, r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS top FROM keyed),
ends AS (SELECT DISTINCT doc_id, r, top.i AS i FROM wide WHERE i + 8 <= n),
sorted AS (SELECT k.*, coalesce(sum(CASE WHEN e.i IS NOT NULL THEN 1 END) OVER (PARTITION BY k.doc_id, k.r ORDER BY k.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM keyed k LEFT JOIN ends e ON k.doc_id = e.doc_id AND k.r = e.r AND k.i = e.i),
pieces AS (SELECT doc_id, r, p, string_agg(word, ' ' ORDER BY i) AS held, string_agg(part, '' ORDER BY i) AS raw, count(*) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY r, p) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM sorted GROUP BY doc_id, r, p),
windows AS (SELECT doc_id, k, n, least(n, 3) AS w, string_agg(held, chr(10)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS held FROM pieces),
ranked AS (SELECT doc_id, k, w, row_number() OVER (PARTITION BY held ORDER BY doc_id, k) AS place FROM windows WHERE k + w - 1 <= n),
covered AS (SELECT DISTINCT doc_id, unnest(range(k, k + w)) AS k FROM ranked WHERE place > 1),
runs AS (SELECT c.doc_id, c.k, p.words, c.k - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.k) AS run FROM covered c JOIN pieces p ON c.doc_id = p.doc_id AND c.k = p.k),
gone AS (SELECT doc_id, k FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS size FROM runs) WHERE size >= 20),
marked AS (SELECT p.*, g.k IS NOT NULL AS is_gone FROM pieces p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k),
left_over AS (SELECT doc_id, r, string_agg(raw, '' ORDER BY p) FILTER (NOT is_gone) AS kept FROM marked GROUP BY doc_id, r),
joined AS (SELECT c.doc_id, string_agg(c.lead || coalesce(o.kept, ''), chr(10) ORDER BY c.r) FILTER (len(c.parts) = 0 OR o.kept IS NOT NULL) AS kept FROM cut c LEFT JOIN left_over o ON c.doc_id = o.doc_id AND c.r = o.r GROUP BY c.doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_gone) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text WHEN n_removed = n_lines THEN '' ELSE kept END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id LEFT JOIN counted c ON d.doc_id = c.doc_id""",
    "op8_url_filter": f"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES
    ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
    ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, {_LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC) AS place
        FROM parted p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE place = 1""",
    "op10_contamination": f"""
WITH parted AS (SELECT item_id, list_filter(string_split_regex({_LOWERED.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
wide AS (SELECT DISTINCT item_id, unnest([array_to_string(list_slice(words, i, i + 9), ' ') FOR i IN range(1, greatest(1, len(words) - 9) + 1)]) AS win, least(10, len(words)) AS width FROM parted WHERE len(words) > 0),
docs AS (SELECT doc_id, list_filter(string_split_regex({_LOWERED.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
places AS (SELECT doc_id, l.width, unnest(range(1, len(words) - l.width + 2)) AS i, words FROM docs, (SELECT DISTINCT width FROM wide) l WHERE len(words) >= l.width),
found AS (SELECT doc_id, i, a.width, item_id FROM (SELECT doc_id, i, width, array_to_string(list_slice(words, i, i + width - 1), ' ') AS win FROM places) a JOIN wide w ON a.win = w.win AND a.width = w.width),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
