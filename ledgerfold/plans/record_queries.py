"""Queries over raw records: the lake, scalar functions, names, pages, codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import names as N
from ledgerfold.functions import scalars as S
from ledgerfold.operators import labels, resolve, serve
from ledgerfold.plans.catalog import query
from ledgerfold.plans.frames import AWARDS_SQL, TENDERS_SQL, awards, table, tenders
from ledgerfold.sources import html, lake

_T, _A, _TA = f"WITH {TENDERS_SQL}", f"WITH {AWARDS_SQL}", f"WITH {TENDERS_SQL}, {AWARDS_SQL}"


@query(f"{_A} SELECT tender_id, line, signed_on, part, bidder_id, round(lakh, 2) AS lakh FROM awards QUALIFY row_number() OVER (PARTITION BY tender_id, line ORDER BY signed_on DESC, part DESC, bidder_id DESC, lakh DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.latest_per_key(awards(spark, sf_dir), ["tender_id", "line"], ["signed_on", "part", "bidder_id", "lakh"]).select("tender_id", "line", "signed_on", "part", "bidder_id", F.round("lakh", 2).alias("lakh"))


@query(f"{_TA} SELECT tender_id, status FROM tenders WHERE tender_id NOT IN (SELECT tender_id FROM awards WHERE method = 'R')")
def known_ids_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.unseen(tenders(spark, sf_dir).select("tender_id", "status"), awards(spark, sf_dir).where("method = 'R'"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS type FROM customer UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), p_name, NULL, p_type FROM part")
def union_by_name_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return lake.union_relaxed([c, p])


@query(f"""{_TA} SELECT t.tender_id, coalesce(max(a.signed_on), substr(t.published_at, 1, 10)) AS day, count(a.tender_id) > 0 AS awarded FROM tenders t LEFT JOIN awards a ON t.tender_id = a.tender_id AND a.method = 'A'
GROUP BY t.tender_id, t.published_at ORDER BY day DESC, t.tender_id LIMIT 200""")
def archive_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = awards(spark, sf_dir).where("method = 'A'").groupBy("tender_id").agg(F.max("signed_on").alias("signed_on"))
    index = tenders(spark, sf_dir).select("tender_id", "published_at").join(a, "tender_id", "left")
    day = F.coalesce("signed_on", F.substring("published_at", 1, 10))
    return index.select("tender_id", day.alias("day"), F.col("signed_on").isNotNull().alias("awarded")).orderBy(F.desc_nulls_last("day"), "tender_id").limit(200)


@query(f"{_TA} SELECT count(*) FILTER (d) AS fetched, count(*) AS indexed, count(*) FILTER (NOT d) AS remaining FROM (SELECT tender_id IN (SELECT tender_id FROM awards WHERE method = 'N') AS d FROM tenders)")
def archive_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = awards(spark, sf_dir).where("method = 'N'").select("tender_id").distinct().withColumn("done", F.lit(True))
    return tenders(spark, sf_dir).select("tender_id").join(done, "tender_id", "left").agg(F.count("done").alias("fetched"), F.count(F.lit(1)).alias("indexed"), F.count_if(F.col("done").isNull()).alias("remaining"))


@query(f"{_TA} SELECT tender_id, published_at FROM tenders WHERE status = 'Live' AND tender_id NOT IN (SELECT tender_id FROM awards WHERE line = 1) ORDER BY published_at DESC, tender_id DESC LIMIT 100")
def live_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = tenders(spark, sf_dir).where("status = 'Live'").select("tender_id", "published_at")
    return lake.unseen(live, awards(spark, sf_dir).where("line = 1")).orderBy(F.desc_nulls_last("published_at"), F.desc("tender_id")).limit(100)


@query(f"{_A} SELECT tender_id, line, part, bidder_id, CASE WHEN lakh > 500 THEN lakh / 1e7 ELSE lakh END AS value FROM awards")
def value_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return awards(spark, sf_dir).select("tender_id", "line", "part", "bidder_id", S.repaired_value(F.col("lakh")).alias("value"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, month(o_orderdate) AS month, year(o_orderdate) - 2020 AS year_offset,
strftime(o_orderdate - INTERVAL 365 DAY, '%Y-%m-%d') AS since FROM orders""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    shown = F.concat(F.lit("Published: "), F.date_format("o_orderdate", "dd-MMM-yyyy HH:mm"), F.lit(" (BST), closing 99-Foo-2026 10:00"))
    day = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "31-Feb-2024").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    return o.select("o_orderkey", S.parse_datetime(shown).alias("at"), S.parse_day(day).alias("day"), F.month("o_orderdate").alias("month"), (F.year("o_orderdate") - 2020).alias("year_offset"), F.date_format(F.date_sub("o_orderdate", 365), "yyyy-MM-dd").alias("since"))


@query("SELECT p_partkey, p_retailprice AS value, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS size, CAST(NULL AS DOUBLE) AS bad FROM part")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.when(F.pmod("p_size", F.lit(4)) == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" BDT")))
    return p.select("p_partkey", S.parse_number(F.concat(F.lit("Tk "), F.col("p_retailprice").cast("string"), F.lit(" crore"))).alias("value"), S.parse_int(size).cast("int").alias("size"), S.parse_number(F.concat(F.col("p_size").cast("string"), F.lit(".1.2"))).alias("bad"))


@query(f"""{_T} SELECT tender_id, length(title) AS title_len, len(string_split(title, ' ')) AS title_words, len(n) AS n_numbers, round(ln(1 + list_max(n)), 6) AS max_number, round(ln(1 + list_sum(n)), 6) AS sum_number, 1 AS has_unit, 1 AS has_year_range
FROM (SELECT *, list_transform(regexp_extract_all(title, '\\d[\\d,]*\\.?\\d*'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS n FROM tenders)""")
def title_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = S.title_numerics(F.col("title"))
    rounded = {k: F.round(c, 6) if k in ("max_number", "sum_number") else c for k, c in made.items()}
    return tenders(spark, sf_dir).select("tender_id", *(c.alias(k) for k, c in rounded.items()))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug, p_name || ' || ' || p_brand || ' ||  || ' || p_type || ' || nature_' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') || ' method_none' AS text FROM part""")
def slug_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(c("p_type")).alias("slug"), S.compose(c("p_name"), c("p_brand"), F.lit(None).cast("string"), c("p_type"), c("p_type"), F.lit("")).alias("text"))


@query("SELECT s_suppkey, substr(sha1(s_name), 1, 12) AS id, substr(sha1('pe:' || s_name), 1, 12) AS salted, '' AS blank, substr(sha256('salt' || s_name), 1, 32) AS hashed FROM supplier")
def entity_id_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.entity_id(n).alias("id"), S.entity_id(n, "pe:").alias("salted"), S.entity_id(F.lit("  ")).alias("blank"), S.address_hash(n, "salt").alias("hashed"))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as people write them: a prefix, a sign, case, punctuation."""
    n = F.col("s_name")
    kind = F.pmod("s_suppkey", F.lit(4))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(kind == 0, F.concat(F.lit("M/S. "), n)).when(kind == 1, F.concat(F.upper(n), F.lit(" & Sons"))).when(kind == 2, F.concat(F.lit("Messrs.  "), n, F.lit(", Ltd."))).otherwise(n).alias("raw"))


_NORM_SQL = """spelled AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'M/S. ' || s_name WHEN 1 THEN upper(s_name) || ' & Sons' WHEN 2 THEN 'Messrs.  ' || s_name || ', Ltd.' ELSE s_name END AS raw FROM supplier),
normed AS (SELECT s_suppkey, raw, trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(trim(raw)), '^(m\\s*/\\s*s\\.?|messrs\\.?|ms\\.?)\\s+', ''), '&', ' and '), '[\\p{P}\\p{S}]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM spelled)"""


@query(f"WITH {_NORM_SQL} SELECT s_suppkey, raw, norm FROM normed")
def normalize_name_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(spark, sf_dir).withColumn("norm", N.normalize_name(F.col("raw")))


@query(f"WITH {_NORM_SQL} SELECT s_suppkey, coalesce(list_filter(string_split(norm, ' '), lambda t: length(t) >= 3)[1], string_split(norm, ' ')[1]) AS block FROM normed")
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spellings(spark, sf_dir).select("s_suppkey", N.block_key(N.normalize_name(F.col("raw"))).alias("block"))


#: Names for pair likeness: a brand with the words of a type, so blocks have many like names.
_PAIR_SQL = """names AS (SELECT DISTINCT lower(p_brand || ' ' || p_type) AS raw FROM part), normed AS (SELECT trim(regexp_replace(regexp_replace(raw, '[\\p{P}\\p{S}]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM names),
b AS (SELECT DISTINCT norm, coalesce(list_filter(string_split(norm, ' '), lambda t: length(t) >= 3)[1], string_split(norm, ' ')[1]) AS block FROM normed),
words AS (SELECT block, norm, ' ' || unnest(string_split(norm, ' ')) || ' ' AS w FROM b),
runs AS (SELECT block, norm, unnest(list_concat(list_concat([substr(w, i, 2) FOR i IN range(1, length(w))], [substr(w, i, 3) FOR i IN range(1, length(w) - 1)]), [substr(w, i, 4) FOR i IN range(1, length(w) - 2)])) AS g FROM words),
tf AS (SELECT block, norm, g, count(*) AS tf FROM runs GROUP BY ALL), sz AS (SELECT block, count(*) AS docs FROM b GROUP BY 1), df AS (SELECT block, g, count(*) AS df FROM tf GROUP BY 1, 2),
wt AS (SELECT block, norm, g, tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM tf JOIN sz USING (block) JOIN df USING (block, g)),
un AS (SELECT block, norm, g, w / sqrt(sum(w * w) OVER (PARTITION BY block, norm)) AS w FROM wt),
pairs AS (SELECT x.norm AS a, y.norm AS b, sum(x.w * y.w) AS score FROM un x JOIN un y ON x.block = y.block AND x.g = y.g AND x.norm < y.norm GROUP BY 1, 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(N.normalize_name(F.concat_ws(" ", "p_brand", "p_type")).alias("norm"))
    return resolve.similar_pairs(resolve.blocks(raw), 0.6)


@query(f"WITH {_PAIR_SQL} SELECT a, b, round(score, 4) AS score FROM pairs WHERE score >= 0.6")
def char_ngram_tfidf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 4))


@query(f"WITH {_PAIR_SQL} SELECT a, b, CASE WHEN length(a) = length(b) THEN 'keep' WHEN score >= 0.85 THEN 'merge' ELSE 'review' END AS verdict FROM pairs WHERE score >= 0.6")
def review_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    decided = pairs.where(F.length("a") == F.length("b")).select("a", "b", F.lit("keep").alias("decision"))
    return resolve.split_pairs(pairs, decided).select("a", "b", "verdict")


@query(f"""WITH RECURSIVE {_PAIR_SQL}, e AS (SELECT a, b FROM pairs WHERE score >= 0.85 UNION SELECT b, a FROM pairs WHERE score >= 0.85), n AS (SELECT DISTINCT norm FROM normed),
r(node, seen) AS (SELECT norm, norm FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(N.normalize_name(F.concat_ws(" ", "p_brand", "p_type")).alias("node")).distinct()
    return resolve.components(names, _pairs(spark, sf_dir).where("score >= 0.85"))


@query()
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _spellings(spark, sf_dir).groupBy(F.col("raw").alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return resolve.resolve(counts)[1]


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).cast("bigint").alias("n_links"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


_CELLS = "'<td>' || {} || '</td>'"


def _list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices rendered as the rows of list pages, a customer a page."""
    t = tenders(spark, sf_dir)
    td = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    b, when = F.lit("<br/>"), F.date_format(F.to_timestamp("published_at", "yyyy-MM-dd'T'HH:mm"), "dd-MMM-yyyy HH:mm")
    row = F.concat(F.lit("<tr>"), td(F.lit("1")), td("tender_id", F.lit(",<br>REF-"), "tender_id", b, "status"), td(F.lit("Goods,<br>"), "title"), td("ministry", F.lit(",<p>"), "procuring_entity"), td(F.lit("NCT,<br>"), "method"), td(when, F.lit(",<br>"), when), F.lit("</tr>"))
    return t.groupBy(F.left("tender_id", F.lit(2)).alias("page")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))


@query(f"{_T} SELECT tender_id, 'REF-' || tender_id AS reference, status, 'Goods' AS nature, title, ministry, procuring_entity, 'NCT' AS procurement_type, method, published_at, published_at AS closing_at FROM tenders")
def list_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.tender_rows(_list_pages(spark, sf_dir))
    return rows.select("tender_id", "reference", "status", "nature", "title", "ministry", "procuring_entity", "procurement_type", "method", "published_at", "closing_at")


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS first_value, '["a","b"]' AS list, '{"id":' || CAST(event_id AS VARCHAR) || ',"none":null}' AS made FROM (SELECT *, json_keys(props)[1] AS k FROM events)""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    return e.select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0)).alias("first_value"), F.to_json(serve.parsed_list(F.lit('["a","b"]'))).alias("list"), made.alias("made"))


@query(f"""{_T} SELECT tender_id, printf('%.2f crore', (estimate + 0.001) / 1000) AS crore, CASE WHEN (estimate + 0.001) / 200000 >= 1 THEN printf('%.2f crore', (estimate + 0.001) / 200000) ELSE printf('%.1f lakh', (estimate + 0.001) / 200000 * 100) END AS amount,
CASE WHEN procuring_entity <> '' THEN procuring_entity END || ', closes ' || ltrim(strftime(strptime(published_at, '%Y-%m-%dT%H:%M'), '%d %b'), '0') AS body, 'status=' || status || '&ministry=' || ministry AS query FROM tenders""")
def format_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    note = S.notification(c("title"), c("procuring_entity"), c("ministry"), c("published_at"), c("tender_id"))
    params = S.query_string({"status": c("status"), "page": F.lit("1"), "ministry": c("ministry"), "q": F.lit("")}, {"page": "1"})
    return tenders(spark, sf_dir).select("tender_id", S.format_crore((c("estimate") + 0.001) / 1000).alias("crore"), S.format_amount((c("estimate") + 0.001) / 200_000).alias("amount"), note["body"].alias("body"), params.alias("query"))


_CODES_SQL = """codes AS (SELECT p_partkey AS tender_id, CAST(10 + p_size AS VARCHAR) || lpad(CAST(p_partkey % 1000 AS VARCHAR), 6, '0') AS code FROM part),
prefixes(prefix, category) AS (VALUES ('1', 'one'), ('11', 'roads'), ('110', 'roads'), ('12', 'food'), ('120', 'silent'), ('2', 'two'), ('20', 'it'), ('200001', 'it2'), ('31', 'power'), ('50', 'repair'), ('51', 'install'), ('45', 'build'), ('450', 'build2'))"""


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    codes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tender_id"), F.concat((F.col("p_size") + 10).cast("string"), F.lpad(F.pmod("p_partkey", F.lit(1000)).cast("string"), 6, "0")).alias("code"))
    listed = [("1", "one"), ("11", "roads"), ("110", "roads"), ("12", "food"), ("120", "silent"), ("2", "two"), ("20", "it"), ("200001", "it2"), ("31", "power"), ("50", "repair"), ("51", "install"), ("45", "build"), ("450", "build2")]
    return codes, spark.createDataFrame(listed, "prefix string, category string")


@query(f"WITH {_CODES_SQL} SELECT tender_id, code, max(prefix) AS prefix, max(category) AS category FROM (SELECT c.tender_id, c.code, p.prefix, p.category FROM codes c LEFT JOIN prefixes p ON starts_with(code, prefix) AND length(prefix) >= 2 QUALIFY row_number() OVER (PARTITION BY c.tender_id ORDER BY length(prefix) DESC NULLS LAST) = 1) GROUP BY 1, 2")
def prefix_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.longest_prefix(*_codes(spark, sf_dir)).select("tender_id", "code", "prefix", "category")


@query(f"""WITH {_CODES_SQL}, tags AS (SELECT tender_id % 300 AS tender_id, code FROM codes), d(division, sector) AS (VALUES ('11', 'construction'), ('12', 'food'), ('20', 'it'), ('31', 'power'), ('45', 'construction'), ('50', 'construction'), ('51', 'it')),
s(category, sector) AS (VALUES ('roads', 'construction'), ('build', 'construction'), ('build2', 'construction'), ('food', 'food'), ('it', 'it'), ('it2', 'it'), ('power', 'power'), ('repair', 'construction'), ('install', 'it')),
looked AS (SELECT t.tender_id, t.code, p.category FROM (SELECT DISTINCT * FROM tags) t LEFT JOIN prefixes p ON starts_with(code, prefix) AND length(prefix) >= 2 QUALIFY row_number() OVER (PARTITION BY t.tender_id, t.code ORDER BY length(prefix) DESC NULLS LAST) = 1),
v AS (SELECT l.*, coalesce(s.sector, d.sector) AS sector, s.sector AS own FROM looked l LEFT JOIN s ON l.category = s.category LEFT JOIN d ON left(code, 2) = division WHERE coalesce(l.category, '') <> 'silent'),
c AS (SELECT tender_id, sector, count(*) AS n FROM v WHERE sector IS NOT NULL GROUP BY 1, 2),
top AS (SELECT tender_id, sector, n, sum(n) OVER w AS whole, row_number() OVER o AS place, lead(n, 1, 0) OVER o AS next FROM c WINDOW w AS (PARTITION BY tender_id), o AS (PARTITION BY tender_id ORDER BY n DESC, sector)),
won AS (SELECT tender_id, sector, n - next AS margin FROM top WHERE place = 1 AND n > next AND n / whole >= 0.5),
f AS (SELECT v.tender_id, category, count(*) AS n FROM v JOIN won ON v.tender_id = won.tender_id AND v.own = won.sector WHERE category IS NOT NULL GROUP BY 1, 2),
ft AS (SELECT tender_id, category, n, sum(n) OVER w AS whole, row_number() OVER o AS place, lead(n, 1, 0) OVER o AS next FROM f WINDOW w AS (PARTITION BY tender_id), o AS (PARTITION BY tender_id ORDER BY n DESC, category))
SELECT k.tender_id, won.sector, CASE WHEN won.sector = 'construction' THEN ft.category ELSE won.sector END AS category, coalesce(margin, 0) AS margin, k.codes FROM (SELECT tender_id, count(DISTINCT code) AS codes FROM tags GROUP BY 1) k LEFT JOIN won USING (tender_id)
LEFT JOIN ft ON k.tender_id = ft.tender_id AND ft.place = 1 AND ft.n > ft.next AND ft.n / ft.whole >= 0.5""")
def cpv_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, prefixes = _codes(spark, sf_dir)
    tags = codes.select(F.pmod("tender_id", F.lit(300)).alias("tender_id"), "code")
    divisions = spark.createDataFrame([("11", 40, "construction"), ("12", 40, "food"), ("20", 40, "it"), ("31", 40, "power"), ("45", 40, "construction"), ("50", 40, "construction"), ("51", 40, "it")], "division string, groups long, sector string")
    sectors = spark.createDataFrame([("roads", "construction"), ("build", "construction"), ("build2", "construction"), ("food", "food"), ("it", "it"), ("it2", "it"), ("power", "power"), ("repair", "construction"), ("install", "it")], "category string, sector string")
    return labels.code_vote(tags, prefixes, divisions, sectors)


#: Keywords of the test's two-way labels.
KEYWORDS = {"metal": ["steel", "brass", "copper", "nickel"], "finish": ["polished", "plated", "burnished", "brushed"], "grade": ["standard", "economy", "promo"]}


@query("""WITH h AS (SELECT p_partkey, [{'n': (contains(t, 'steel'))::INT + contains(t, 'brass')::INT + contains(t, 'copper')::INT + contains(t, 'nickel')::INT, 'c': 'metal'}, {'n': contains(t, 'polished')::INT + contains(t, 'plated')::INT + contains(t, 'burnished')::INT + contains(t, 'brushed')::INT, 'c': 'finish'},
{'n': contains(t, 'standard')::INT + contains(t, 'economy')::INT + contains(t, 'promo')::INT, 'c': 'grade'}] AS x FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part)), s AS (SELECT p_partkey, list_sort(x, 'DESC') AS x FROM h)
SELECT p_partkey, CASE WHEN x[1].n > 0 AND x[1].n > x[2].n THEN x[1].c END AS label, CASE WHEN x[1].n > 0 THEN x[1].n - x[2].n ELSE 0 END AS margin FROM s""")
def keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, margin = labels.keyword_label(F.concat_ws(" ", "p_name", "p_type"), KEYWORDS)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), margin.alias("margin"))
