"""Queries over texts, codes and names with the fixed tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import names as N
from ledgerfold.functions import scalars as S
from ledgerfold.functions import taxonomy
from ledgerfold.operators import labels
from ledgerfold.plans.catalog import query
from ledgerfold.plans.frames import TENDERS_SQL, table, tenders
from ledgerfold.plans.record_queries import _PAIR_SQL, _pairs
from ledgerfold.sources import lake

_T = f"WITH {TENDERS_SQL}"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _rows(pairs) -> str:
    shown = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(shown, row))})" for row in pairs)


@query(f"""{_T} SELECT tender_id, lower(trim(regexp_replace(' PKG - ' || tender_id || ' /' || method || ',,', '\\s+', '', 'g'), ',')) AS package, substr(fetched_at, 1, 4) || '-' || substr(fetched_at, 5, 2) || '-' || substr(fetched_at, 7, 2) AS day,
printf('%.1f %%', (estimate + 0.001) / 1000000 * 100) AS pct, printf('%.2fx', (estimate + 0.001) / 1000) AS multiple, epoch(TIMESTAMP '1996-01-01') - epoch(strptime(published_at, '%Y-%m-%dT%H:%M')) > 36 * 3600 AS stale,
CAST(floor((epoch(strptime(published_at, '%Y-%m-%dT%H:%M')) - 6 * 3600 - epoch(TIMESTAMP '1996-01-01')) / 86400) AS BIGINT) AS days_left, substr(sha256('salt' || title), 1, 32) AS address,
regexp_replace('failed at ' || tender_id || '000000 of ' || pe_id, '\\d{{6,}}', '#', 'g') AS error, method || '|' || CASE WHEN estimate >= 200000 THEN '2' WHEN estimate >= 100000 THEN '1' ELSE '0' END AS conformal FROM tenders""")
def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = tenders(spark, sf_dir), F.col
    now = F.lit("1996-01-01").cast("timestamp")
    at = F.to_timestamp("published_at", "yyyy-MM-dd'T'HH:mm")
    return t.select(
        "tender_id", S.package_key(F.concat(F.lit(" PKG - "), "tender_id", F.lit(" /"), "method", F.lit(",,"))).alias("package"), S.stamp_day(c("fetched_at")).alias("day"), S.format_figure((c("estimate") + 0.001) / 1_000_000, "pct").alias("pct"),
        S.format_figure((c("estimate") + 0.001) / 1000, "multiple").alias("multiple"), S.is_stale(at, now).alias("stale"), S.days_left(c("published_at"), now).alias("days_left"), S.address_hash(c("title"), "salt").alias("address"),
        S.masked_error(F.concat(F.lit("failed at "), "tender_id", F.lit("000000 of "), "pe_id")).alias("error"), S.conformal_key(c("method"), c("estimate"), [100_000.0, 200_000.0]).alias("conformal"),
    )


@query("""WITH l AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, p_type || '; ' || p_brand AS label FROM part), e AS (SELECT code, label FROM l UNION ALL SELECT code, string_split(label, ';')[1] FROM l)
SELECT label, count(*) AS n FROM (SELECT DISTINCT lower(trim(label)) AS label, code FROM e) GROUP BY 1""")
def code_list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many codes a folded label, or its part before a semicolon, may stand for."""
    rows = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.concat_ws("; ", "p_type", "p_brand").alias("label"))
    return labels.code_names(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_CODES = "codes AS (SELECT p_partkey, lpad(CAST((p_partkey * 7919 + p_size * 104729) % 100000000 AS VARCHAR), 8, '0') AS code FROM part)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.pmod(F.col("p_partkey") * 7919 + F.col("p_size") * 104_729, F.lit(100_000_000))
    return table(spark, sf_dir, "part").select("p_partkey", F.lpad(number.cast("string"), 8, "0").alias("code"))


@query(f"""WITH {_CODES}, p(prefix, category) AS (VALUES {_rows(taxonomy.PREFIXES.items())})
SELECT p_partkey, c.code, b.prefix, b.category FROM codes c LEFT JOIN (SELECT code, prefix, category FROM (SELECT DISTINCT code FROM codes) d JOIN p ON starts_with(d.code, p.prefix) QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(prefix) DESC) = 1) b ON c.code = b.code""")
def taxonomy_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of codes by the domain's own table of prefixes."""
    return labels.longest_prefix(_codes(spark, sf_dir), taxonomy.prefixes(spark)).select("p_partkey", "code", "prefix", "category")


_HITS = ", ".join("{'n': " + " + ".join(f"contains(x, '{w}')::INT" for w in words) + f", 'c': '{c}'}}" for c, words in taxonomy.IN_TITLES.items())


@query(f"""WITH t AS (SELECT p_partkey, lower(p_name || ' road ' || p_type || CASE p_partkey % 4 WHEN 0 THEN ' building' WHEN 1 THEN ' laptop and printer' WHEN 2 THEN ' fish' ELSE '' END) AS x FROM part), h AS (SELECT p_partkey, list_reverse_sort([{_HITS}]) AS hits FROM t)
SELECT p_partkey, CASE WHEN hits[1].n > hits[2].n THEN hits[1].c END AS category, CASE WHEN hits[1].n > 0 THEN hits[1].n - hits[2].n ELSE 0 END AS margin FROM h""")
def taxonomy_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of titles by the domain's own keywords."""
    key = F.pmod("p_partkey", F.lit(4))
    more = F.when(key == 0, " building").when(key == 1, " laptop and printer").when(key == 2, " fish").otherwise("")
    category, margin = labels.keyword_label(F.concat("p_name", F.lit(" road "), "p_type", more), taxonomy.IN_TITLES)
    return table(spark, sf_dir, "part").select("p_partkey", category.alias("category"), margin.alias("margin"))


_TAG_HITS = ", ".join("{'n': " + " + ".join(f"contains(x, '{w}')::INT" for w in words) + f", 'c': '{c}'}}" for c, words in taxonomy.IN_TAGS.items())


@query(f"""WITH t AS (SELECT p_partkey, lower(p_type || CASE p_partkey % 5 WHEN 0 THEN ' school building and hostel' WHEN 1 THEN ' water supply' WHEN 2 THEN ' Printer, scanner' WHEN 3 THEN ' paper and pen' ELSE '' END) AS x FROM part), h AS (SELECT p_partkey, list_reverse_sort([{_TAG_HITS}]) AS hits FROM t),
k AS (SELECT p_partkey, CASE WHEN hits[1].n > hits[2].n THEN hits[1].c END AS category FROM h), n(slug, label) AS (VALUES {_rows(taxonomy.NAMES.items())})
SELECT p_partkey, category, coalesce(label, replace(category, '_', ' ')) AS label FROM k LEFT JOIN n ON category = slug""")
def taxonomy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of tags by the domain's own keywords, with the names that are shown."""
    key = F.pmod("p_partkey", F.lit(5))
    more = F.when(key == 0, " school building and hostel").when(key == 1, " water supply").when(key == 2, " Printer, scanner").when(key == 3, " paper and pen").otherwise("")
    category, _ = labels.keyword_label(F.concat("p_type", more), taxonomy.IN_TAGS)
    return table(spark, sf_dir, "part").select("p_partkey", category.alias("category")).withColumn("label", labels.shown_label(F.col("category"), taxonomy.NAMES))


def _core_sql(x: str) -> str:
    plain = f"list_transform(list_filter(string_split({x}, ' '), lambda t: t <> ''), lambda t: coalesce(element_at(plurals, t)[1], t))"
    kept = f"list_filter({plain}, lambda t: NOT list_contains({_list([*N.HONORIFICS, *N.LEGAL])}, t))"
    line = f"array_to_string(list_transform({kept}, lambda t: CASE WHEN length(t) = 1 THEN chr(1) || t || chr(1) ELSE t END), ' ')"
    return f"list_filter(string_split(replace(replace({line}, chr(1) || ' ' || chr(1), ''), chr(1), ''), ' '), lambda t: t <> '')"


_PLURALS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.PLURALS.items()) + "}"


@query(f"""WITH {_PAIR_SQL}, q AS (SELECT a, b FROM pairs WHERE score >= 0.6), m AS (SELECT a, b, {_PLURALS} AS plurals FROM q), c AS (SELECT a, b, {_core_sql("a")} AS ca, {_core_sql("b")} AS cb FROM m),
d AS (SELECT *, list_distinct(list_filter(ca, lambda t: NOT list_contains(cb, t))) AS oa, list_distinct(list_filter(cb, lambda t: NOT list_contains(ca, t))) AS ob FROM c)
SELECT a, b, CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN '' WHEN list_sort(ca) = list_sort(cb) THEN 'merge' WHEN (len(oa) = 0) <> (len(ob) = 0) THEN '' WHEN len(list_filter(list_concat(oa, ob), lambda t: regexp_matches(t, '\\d'))) > 0 THEN 'keep'
WHEN len(oa) = 1 AND len(ob) = 1 AND (starts_with(oa[1], ob[1]) OR starts_with(ob[1], oa[1])) THEN '' ELSE 'keep' END AS decision FROM d""")
def adjudicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", N.pair_decision(F.col("a"), F.col("b")).alias("decision"))


@query("""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS stamp, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1) SELECT * FROM (SELECT * FROM r ORDER BY stamp DESC LIMIT 7)""")
def last_runs_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest seven days; each stands for a run, written twice."""
    runs = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("stamp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return lake.last_runs(runs.unionByName(runs), "stamp", 7)
