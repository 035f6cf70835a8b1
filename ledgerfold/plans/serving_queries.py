"""Queries behind the pages, alerts and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import load, quality, serve
from ledgerfold.plans.catalog import query
from ledgerfold.plans.frames import AWARDS_SQL, TENDERS_SQL, awards, table, tenders
from ledgerfold.storage import saved
from ledgerfold.streaming import alerts, ingest

_T, _TA = f"WITH {TENDERS_SQL}", f"WITH {TENDERS_SQL}, {AWARDS_SQL}"
_SHOWN = ["tender_id", "status", "ministry", "title", "published_at"]
_COLS = ", ".join(_SHOWN)
#: Categories that stand under another, as lists are asked for them.
CHILDREN = {"machinery": ["automobile", "building"]}


@query(f"{_T} SELECT {_COLS} FROM tenders WHERE status = 'Live' ORDER BY published_at DESC, tender_id LIMIT 25")
def tender_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.listed(tenders(spark, sf_dir), serve.Filters()).select(*_SHOWN)


@query(f"{_T} SELECT {_COLS} FROM tenders WHERE ministry = 'ASIA' ORDER BY published_at DESC, tender_id LIMIT 40 OFFSET 80")
def tender_list_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.listed(tenders(spark, sf_dir), serve.Filters.of({"ministry": "ASIA", "status": "all", "page": "3", "size": "40"})).select(*_SHOWN)


@query(f"{_T} SELECT {_COLS} FROM tenders WHERE status = 'Live' AND title ILIKE '%SUPPLY of 7%' ORDER BY published_at DESC, tender_id LIMIT 100")
def tender_search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.listed(tenders(spark, sf_dir), serve.Filters.of({"q": "SUPPLY of 7", "size": "500"})).select(*_SHOWN)


@query(f"{_T} SELECT {_COLS} FROM tenders WHERE status = 'Live' AND category IN ('machinery', 'automobile', 'building') ORDER BY published_at DESC, tender_id LIMIT 25")
def tender_category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.listed(tenders(spark, sf_dir), serve.Filters.of({"category": "machinery"}), CHILDREN).select(*_SHOWN)


@query(f"{_T} SELECT ministry AS value, count(*) AS n FROM tenders WHERE status = 'Live' GROUP BY 1 ORDER BY n DESC, value LIMIT 60")
def facet_ministry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.facet(tenders(spark, sf_dir), "ministry", serve.Filters(ministry="ASIA"), 60)


@query(f"{_T} SELECT status AS value, count(*) AS n FROM tenders WHERE ministry = 'ASIA' GROUP BY 1 ORDER BY n DESC, value LIMIT 60")
def facet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.facet(tenders(spark, sf_dir), "status", serve.Filters(ministry="ASIA"), 60)


@query(f"{_T} SELECT category AS value, count(*) AS n FROM tenders WHERE status = 'Live' AND method = '1-URGENT' GROUP BY 1 ORDER BY n DESC, value LIMIT 70")
def facet_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.facet(tenders(spark, sf_dir), "category", serve.Filters(method="1-URGENT"), 70)


@query(f"""{_T} SELECT facet, value, count(*) AS n FROM (SELECT 'status' AS facet, status AS value FROM tenders UNION ALL SELECT 'ministry', ministry FROM tenders
UNION ALL SELECT 'category', category FROM tenders UNION ALL SELECT 'method', method FROM tenders) GROUP BY 1, 2""")
def facets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.facets(tenders(spark, sf_dir), ["status", "ministry", "category", "method"])


@query(f"{_TA} SELECT t.tender_id, status, a.line, a.bidder_id, a.awardee, a.signed_on, a.value_crore FROM tenders t LEFT JOIN awards a ON t.tender_id = a.tender_id WHERE t.ministry = 'EUROPE'")
def tender_detail_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, a = tenders(spark, sf_dir).where("ministry = 'EUROPE'").select("tender_id", "status"), awards(spark, sf_dir)
    return t.join(a.select("tender_id", "line", "bidder_id", "awardee", "signed_on", "value_crore"), "tender_id", "left")


@query(f"""{_TA} SELECT * FROM (SELECT count(*) AS tenders, count(*) FILTER (status = 'Live') AS live, max(published_at) AS last_published, max(fetched_at) AS last_fetched FROM tenders),
(SELECT count(*) AS contracts, count(DISTINCT bidder_id) AS bidders, max(signed_on) AS last_signed FROM awards)""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.summary(tenders(spark, sf_dir), awards(spark, sf_dir))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT events.*, ts > now - INTERVAL 7 DAY AS w, ts > now - INTERVAL 30 DAY AS m FROM events, n)
SELECT count(*) AS events, count(*) FILTER (w) AS events_7d, count(*) FILTER (m) AS events_30d, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (w) AS users_7d,
count(DISTINCT user_id) FILTER (m) AS users_30d, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, round(sum(value) FILTER (m), 2) AS value_30d FROM e""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return serve.usage(events.crossJoin(F.broadcast(now)), F.col("now")).withColumn("last_event", F.date_format(F.col("last_event").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))  # one row


@query("""SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, count(*) OVER w AS in_hour, count(*) OVER w <= 2 AS allowed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""")
def rate_limit_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").alias("hash"), "ts")
    return alerts.rate_limited(events, 2).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "in_hour", "allowed")


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each customer: notices of its region that name its segment, or any of one category."""
    c = table(spark, sf_dir, "customer")
    f = lambda q, ministry, status, district, category: F.struct(q.alias("q"), ministry.alias("ministry"), status.alias("status"), district.alias("district"), category.alias("category"))
    none = F.lit("")
    return c.select(F.col("c_custkey").cast("string").alias("sub_id"), F.array(f(F.col("c_mktsegment"), F.lit("ASIA"), none, none, none), f(F.lit("sets 2024"), none, F.lit("Live"), none, F.lit("machinery")), f(none, none, none, none, none), f(none, none, none, F.lit("Dhaka"), none)).alias("filters"))


@query(f"""{_T}, next AS (SELECT * FROM tenders WHERE status = 'Live' ORDER BY fetched_at, tender_id LIMIT 500),
subs AS (SELECT CAST(c_custkey AS VARCHAR) AS sub_id, lower(c_mktsegment) AS seg FROM customer),
met AS (SELECT DISTINCT sub_id, tender_id, fetched_at FROM next, subs WHERE (contains(lower(title), seg) AND ministry = 'ASIA') OR (contains(lower(title), 'sets 2024') AND category IN ('machinery', 'automobile', 'building'))),
fresh AS (SELECT * FROM met WHERE CAST(tender_id AS BIGINT) % 7 <> 0)
SELECT sub_id, tender_id, fetched_at FROM fresh QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY fetched_at, tender_id) <= 20""")
def alert_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    next_ = saved(alerts.candidates(tenders(spark, sf_dir), ""), "next")
    subs = _subscriptions(spark, sf_dir).repartition("sub_id")
    sent = subs.select("sub_id").crossJoin(F.broadcast(next_.where(F.pmod(F.col("tender_id").cast("bigint"), F.lit(7)) == 0).select("tender_id")))  # 500 rows at most
    return alerts.matched(next_, subs, sent, CHILDREN)


@query(f"""{_T}, q AS (SELECT 'tenders_live' AS part, 1 AS priority, 8 AS weight, fetched_at AS stamp, tender_id AS key FROM tenders WHERE status = 'Live'
UNION ALL SELECT 'procuring_entities', 3, 2, NULL, CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'bidders', 4, 2, NULL, CAST(s_suppkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'tenders_backlog', 5, 8, fetched_at, tender_id FROM tenders WHERE status <> 'Live')
SELECT part, key, CAST(sum(weight) OVER w AS BIGINT) AS cost, sum(weight) OVER w <= 60000 AS taken FROM q
WINDOW w AS (ORDER BY priority, part, stamp NULLS FIRST, key ROWS UNBOUNDED PRECEDING)""")
def budgeted_load_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir)
    part = lambda df, name, priority, weight, at, key: df.select(F.lit(name).alias("part"), F.lit(priority).alias("priority"), F.lit(weight).alias("weight"), at.alias("at"), key.cast("string").alias("key"))
    none, at, key = F.lit(None).cast("string"), F.col("fetched_at"), F.col("tender_id")
    queue = part(t.where("status = 'Live'"), "tenders_live", 1, 8, at, key).unionByName(part(table(spark, sf_dir, "nation"), "procuring_entities", 3, 2, none, F.col("n_nationkey")))
    queue = queue.unionByName(part(table(spark, sf_dir, "supplier"), "bidders", 4, 2, none, F.col("s_suppkey"))).unionByName(part(t.where("status <> 'Live'"), "tenders_backlog", 5, 8, at, key))
    return load.planned(queue, 60_000).select("part", "key", "cost", "taken")


@query("""WITH fresh AS (SELECT s_suppkey, 'new ' || s_name AS s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 10 = 0)
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM fresh)
UNION ALL SELECT f.s_suppkey, f.s_name, f.s_nationkey, coalesce(s.s_acctbal, f.s_acctbal) FROM fresh f LEFT JOIN supplier s ON f.s_suppkey = s.s_suppkey""")
def load_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    changed = s.where(F.pmod("s_suppkey", F.lit(3)) == 0).withColumns({"s_name": F.concat(F.lit("new "), "s_name"), "s_acctbal": F.col("s_acctbal") + 1})
    new = s.where(F.pmod("s_suppkey", F.lit(10)) == 0).withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)
    return load.upserted(s, changed.unionByName(new), ["s_suppkey"], keep=["s_acctbal"])


@query("SELECT '(' || CAST(s_suppkey AS VARCHAR) || ', ''' || replace(s_name, '''', '''''') || ''', ' || CAST(s_nationkey AS VARCHAR) || ')' AS value FROM supplier")
def sql_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load.statements(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier", ["s_suppkey"])
    body = F.regexp_replace(F.regexp_replace("statement", r"^[^\n]*\n", ""), r";$", "")
    return rows.select(F.explode(F.split(body, r",\n")).alias("value"))


@query(f"""{_T}, live AS (SELECT tender_id, CASE WHEN method = '1-URGENT' THEN 'model' ELSE 'portal' END AS source FROM tenders WHERE status = 'Live'),
p AS (SELECT tender_id, estimate * 0.8 AS lo, CASE WHEN method = '5-LOW' AND category = 'furniture' THEN estimate * 0.7 ELSE estimate END AS mid, estimate * 1.2 AS hi FROM tenders WHERE method <> '2-HIGH'),
c AS (SELECT (SELECT count(*) FROM live) AS live, (SELECT count(*) FROM live WHERE source <> 'portal') AS untagged, (SELECT count(*) FROM live WHERE source = 'model') AS modelled, (SELECT count(*) FROM p WHERE lo > mid OR mid > hi) AS crossed,
(SELECT count(*) FROM p WHERE mid > 500000) AS huge, (SELECT count(*) FROM live WHERE tender_id IN (SELECT tender_id FROM p)) AS covered)
SELECT 'rejected_models' AS name, CAST(0 AS BIGINT) AS seen, false AS failed UNION ALL SELECT 'uncategorised', modelled, untagged > 0 AND modelled = 0 FROM c UNION ALL SELECT 'coverage', covered, covered < 0.95 * live FROM c
UNION ALL SELECT 'band_order', crossed, crossed > 0 FROM c UNION ALL SELECT 'band_size', huge, huge > 0 FROM c""")
def pipeline_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir)
    e = F.col("estimate")
    mid = F.when((F.col("method") == "5-LOW") & (F.col("category") == "furniture"), e * 0.7).otherwise(e)
    bands = t.where("method <> '2-HIGH'").select("tender_id", (e * 0.8).alias("q10_lakh"), mid.alias("q50_lakh"), (e * 1.2).alias("q90_lakh"))
    tagged = t.withColumn("category_source", F.when(F.col("method") == "1-URGENT", "model").otherwise("portal"))
    return quality.invariants(tagged, bands, t.where("false"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.tumbling(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT d AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1, 2")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sliding(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
