"""Queries over the steps of a night: loads and their marks, runs of alerts, securities, the plan route's test, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import bands, evaluate, history, load, report, serve
from ledgerfold.plans.catalog import query
from ledgerfold.plans.frames import AWARDS_SQL, TENDERS_SQL, awards, table, tenders
from ledgerfold.plans.model_queries import _FIG, _PAIRS, _figures, _plan_pairs
from ledgerfold.streaming import alerts

_T, _A, _TA = f"WITH {TENDERS_SQL}", f"WITH {AWARDS_SQL}", f"WITH {TENDERS_SQL}, {AWARDS_SQL}"

_B = "b AS (SELECT bidder_id, max(signed_on) AS last_award FROM awards GROUP BY 1), n AS (SELECT count(*) AS n, max(last_award) AS newest FROM b)"


def _bidders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return awards(spark, sf_dir).groupBy("bidder_id").agg(F.max("signed_on").alias("last_award"))


@query(f"""{_A}, {_B}, o AS (SELECT *, row_number() OVER (ORDER BY bidder_id) AS i FROM b), half AS (SELECT n // 2 AS k FROM n), lasts AS (SELECT max(bidder_id) AS after FROM o, half WHERE i <= k)
SELECT 1 AS run, bidder_id, last_award, '' AS bidders, after AS bidders_after FROM o, half, lasts WHERE i <= k UNION ALL SELECT 2, bidder_id, last_award, newest, '' FROM o, half, n WHERE i > k""")
def bidder_first_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first load in two runs: the budget of the first is half of all bidders."""
    rows, out, mark = _bidders(spark, sf_dir), None, load.Watermark()
    n = rows.count()
    for run, budget in ((1, 2 * (n // 2)), (2, 2 * n)):
        taken, mark = load.bidder_load(rows, mark, budget, "1970-01-01")
        got = taken.select(F.lit(run).alias("run"), "bidder_id", "last_award", F.lit(mark.bidders).alias("bidders"), F.lit(mark.bidders_after).alias("bidders_after"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"""{_A}, {_B}, m AS (SELECT strftime(CAST(newest AS DATE) - INTERVAL 10 DAY, '%Y-%m-%d') AS mark FROM n), p AS (SELECT b.*, row_number() OVER (ORDER BY last_award DESC, bidder_id) AS i FROM b, m WHERE last_award >= strftime(CAST(mark AS DATE) - INTERVAL 3 DAY, '%Y-%m-%d'))
SELECT 'whole' AS budget, bidder_id, last_award, newest AS bidders FROM p, n UNION ALL SELECT 'five', bidder_id, last_award, CASE WHEN (SELECT count(*) FROM p) <= 5 THEN newest ELSE mark END FROM p, m, n WHERE i <= 5""")
def bidder_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later load from a mark ten days back: with budget for all, and for five."""
    rows = _bidders(spark, sf_dir)
    mark = load.Watermark(bidders=rows.agg(F.date_format(F.date_sub(F.max("last_award").cast("date"), 10), "yyyy-MM-dd")).first()[0])
    out = None
    for name, budget in (("whole", 2 * rows.count()), ("five", 10)):
        taken, after = load.bidder_load(rows, mark, budget, "1970-01-01")
        got = taken.select(F.lit(name).alias("budget"), "bidder_id", "last_award", F.lit(after.bidders).alias("bidders"))
        out = got if out is None else out.unionByName(got)
    return out


_L = """loads AS (SELECT o_orderpriority AS stream, o_orderkey AS run, strftime(o_orderdate, '%Y-%m-%d') AS mark, 'load-' || CAST(o_orderkey AS VARCHAR) AS token, o_orderkey % 7 AS statements,
CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey % 7 END AS done, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 'load-0' ELSE 'load-' || CAST(o_orderkey AS VARCHAR) END AS read_back FROM orders)"""


@query(f"""WITH {_L}, c AS (SELECT *, done = statements AND read_back IS NOT DISTINCT FROM token AS ok FROM loads)
SELECT stream, arg_max(mark, run) FILTER (ok) AS mark, count(*) FILTER (ok) AS confirmed, count(*) FILTER (NOT ok) AS failed FROM c GROUP BY 1""")
def load_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks move with loads whose marker was read back; orders stand for loads."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    token = F.concat(F.lit("load-"), key.cast("string"))
    statements = F.pmod(key, F.lit(7))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("stream"), key.alias("run"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("mark"), token.alias("token"), statements.alias("statements"),
        F.when(F.pmod(who, F.lit(5)) == 0, 0).otherwise(statements).alias("done"), F.when(F.pmod(who, F.lit(3)) == 0, F.lit(None).cast("string")).when(F.pmod(who, F.lit(11)) == 0, "load-0").otherwise(token).alias("read_back"),
    )
    return load.confirmed(o)


_R = "runs AS (SELECT strftime(ts, '%Y-%m-%d %H') AS ran_at, min(event_id) AS id, CASE WHEN min(event_id) % 7 = 0 THEN '' ELSE 'load ' || CAST(min(user_id) % 3 AS VARCHAR) END AS load FROM events GROUP BY 1)"


@query(f"""WITH {_R}, k AS (SELECT *, last_value(nullif(load, '') IGNORE NULLS) OVER (ORDER BY ran_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM runs)
SELECT ran_at, load, load = '' OR load IS DISTINCT FROM was AS examined FROM k""")
def alert_runs_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with events stand for runs, some without a load marker."""
    hours = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("ran_at")).agg(F.min("event_id").alias("id"), F.min("user_id").alias("who"))
    marker = F.when(F.pmod("id", F.lit(7)) == 0, "").otherwise(F.concat(F.lit("load "), F.pmod("who", F.lit(3)).cast("string")))
    return alerts.due(hours.select("ran_at", marker.alias("load")))


@query("""WITH log AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS ran_at, (event_id % 9 = 0)::INT AS errored, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 20 END AS candidates, CASE WHEN event_id % 9 = 0 THEN 0 ELSE user_id % 4 END AS sent,
CASE WHEN event_id % 9 = 0 THEN left(regexp_replace('TypeError: row ' || CAST(event_id * 1000003 AS VARCHAR) || ' of ' || event_type, '\\d{6,}', '#', 'g'), 200) END AS error FROM events)
SELECT count(*) AS runs, CAST(sum(errored) AS BIGINT) AS errored, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(0 AS BIGINT) AS subscriptions, CAST(0 AS BIGINT) AS matched, CAST(sum(sent) AS BIGINT) AS sent, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS pruned, max(ran_at) AS last_run, arg_max(error, ran_at) FILTER (errored = 1) AS last_error FROM log""")
def alert_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for runs, of which every ninth failed."""
    bad, key = F.pmod("event_id", F.lit(9)) == 0, F.col("event_id")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("|"), F.lpad(key.cast("string"), 12, "0"))
    message = F.concat(F.lit("row "), (key * 1_000_003).cast("string"), F.lit(" of "), F.col("event_type"))
    none = {c: F.lit(0).cast("bigint") for c in alerts.RUN_FIGURES}
    counts = none | {"candidates": F.when(bad, 0).otherwise(F.pmod(key, F.lit(20))).cast("bigint"), "sent": F.when(bad, 0).otherwise(F.pmod("user_id", F.lit(4))).cast("bigint")}
    log = table(spark, sf_dir, "events").select(at.alias("ran_at"), bad.cast("int").alias("errored"), *(c.alias(k) for k, c in counts.items()), F.when(bad, alerts.error_text(F.lit("TypeError"), message)).alias("error"))
    return alerts.run_summary(log)


@query(f"""{_A}, v AS (SELECT method, CASE WHEN line % 4 = 0 THEN NULL WHEN line % 4 = 1 THEN -value_crore ELSE value_crore END AS value, CASE WHEN part % 3 = 0 THEN NULL WHEN part % 3 = 1 THEN '' ELSE signed_on END AS day FROM awards)
SELECT method, count(*) AS n, count(*) FILTER (coalesce(value, 0) > 0 AND coalesce(day, '') <> '') AS usable FROM v GROUP BY 1""")
def usable_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = F.pmod("line", F.lit(4)), F.pmod("part", F.lit(3))
    value = F.when(line == 0, F.lit(None).cast("double")).when(line == 1, -F.col("value_crore")).otherwise(F.col("value_crore"))
    day = F.when(part == 0, F.lit(None).cast("string")).when(part == 1, "").otherwise(F.col("signed_on"))
    return awards(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(bands.usable(value, day)).alias("usable"))


_S = "own AS (SELECT tender_id, line, part, bidder_id, CASE WHEN line % 3 = 0 THEN security_lakh END AS security_bdt FROM awards), det AS (SELECT tender_id, fetched_at, CASE WHEN CAST(tender_id AS BIGINT) % 5 > 0 THEN estimate END AS security_bdt FROM tenders UNION ALL SELECT tender_id, fetched_at || 'x', estimate / 2 FROM tenders WHERE CAST(tender_id AS BIGINT) % 4 = 0)"


@query(f"""{_TA}, {_S}, d AS (SELECT tender_id, arg_max(coalesce(security_bdt, -1), fetched_at) AS s FROM det GROUP BY 1)
SELECT o.tender_id, line, part, bidder_id, round(coalesce(o.security_bdt, CASE WHEN d.s >= 0 THEN d.s END), 4) AS security_bdt FROM own o LEFT JOIN d USING (tender_id)""")
def security_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, key = tenders(spark, sf_dir), F.col("tender_id").cast("bigint")
    own = awards(spark, sf_dir).select("tender_id", "line", "part", "bidder_id", F.when(F.pmod("line", F.lit(3)) == 0, F.col("security_lakh")).alias("security_bdt"))
    pages = t.select("tender_id", "fetched_at", F.when(F.pmod(key, F.lit(5)) > 0, F.col("estimate")).alias("security_bdt"))
    again = t.where(F.pmod(key, F.lit(4)) == 0).select("tender_id", F.concat("fetched_at", F.lit("x")).alias("fetched_at"), (F.col("estimate") / 2).alias("security_bdt"))
    return bands.attached_security(own, pages.unionByName(again)).select("tender_id", "line", "part", "bidder_id", F.round("security_bdt", 4).alias("security_bdt"))


@query(f"""{_A}, g AS (SELECT max(lakh) AS most FROM awards), i AS (SELECT tender_id, line, part, bidder_id, CASE WHEN line = 1 THEN security_lakh * 400 WHEN line = 2 THEN 0 ELSE security_lakh END AS s FROM awards)
SELECT tender_id, line, part, bidder_id, CASE WHEN s > 0 AND exp(3.5) * s <= 5 * most THEN round(exp(3.5) * s, 2) END AS implied FROM i, g""")
def security_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = awards(spark, sf_dir)
    s = F.when(F.col("line") == 1, F.col("security_lakh") * 400).when(F.col("line") == 2, F.lit(0.0)).otherwise(F.col("security_lakh"))
    most = a.agg(F.max("lakh").alias("most"))
    return a.crossJoin(F.broadcast(most)).select("tender_id", "line", "part", "bidder_id", F.round(bands.believed(F.lit(3.5), s, F.col("most")), 2).alias("implied"))  # one row


_WEEKS = "ok AS (SELECT *, ln(lakh / security_lakh) AS r, CAST(date_trunc('week', CAST(signed_on AS DATE)) AS DATE) AS week FROM awards WHERE lakh / security_lakh BETWEEN 5 AND 300)"


@query(f"""{_A}, {_WEEKS}, asked AS (SELECT week FROM (SELECT week, count(*) AS n FROM ok GROUP BY 1 ORDER BY 1 DESC LIMIT 12) WHERE n >= 20),
e AS (SELECT a.week, o.pe_id, o.method, o.r FROM asked a JOIN ok o ON o.week < a.week), ov AS (SELECT week, median(r) AS overall FROM e GROUP BY 1 HAVING count(*) >= 50),
bm AS (SELECT week, method, median(r) AS by_method FROM e WHERE method <> '' GROUP BY 1, 2 HAVING count(*) >= 50), ow AS (SELECT week, pe_id, median(r) AS own, count(*) AS k FROM e WHERE pe_id <> '' GROUP BY 1, 2),
f AS (SELECT pe_id, arg_min(method, signed_on || '|' || tender_id || '|' || method) AS method FROM ok GROUP BY 1),
be AS (SELECT week, pe_id, (own * k + coalesce(by_method, overall) * 10) / (k + 10) AS by_entity FROM ow JOIN f USING (pe_id) LEFT JOIN bm USING (week, method) JOIN ov USING (week)),
pl AS (SELECT week, overall, row_number() OVER (ORDER BY week) AS place FROM ov),
ms AS (SELECT o.week, place, r - coalesce(by_entity, by_method, overall) AS miss FROM ok o JOIN pl ON o.week = pl.week LEFT JOIN be ON o.week = be.week AND o.pe_id = be.pe_id LEFT JOIN bm ON o.week = bm.week AND o.method = bm.method),
pool AS (SELECT p.place AS spot, m.miss, row_number() OVER (PARTITION BY p.place ORDER BY m.miss) - 1 AS i, count(*) OVER (PARTITION BY p.place) AS n FROM pl p JOIN ms m ON m.place BETWEEN p.place - 4 AND p.place - 1 WHERE p.place > 4),
lv AS (SELECT *, greatest(0.0, 0.1::DOUBLE * (n + 1) / n) * (n - 1) AS l, least(1.0, 0.9::DOUBLE * (n + 1) / n) * (n - 1) AS h FROM pool),
ed AS (SELECT spot, sum(miss * greatest(0, 1 - abs(i - l))) AS lo, sum(miss * greatest(0, 1 - abs(i - h))) AS hi FROM lv GROUP BY 1)
SELECT strftime(week, '%Y-%m-%d') AS week, count(*) AS n, round(lo, 4) AS lo, round(hi, 4) AS hi, round(avg((miss BETWEEN lo AND hi)::INT), 3) AS coverage, round(median(abs(exp(-miss) - 1)), 4) AS mape, round(exp(hi - lo), 3) AS width FROM ms JOIN ed ON spot = place GROUP BY week, lo, hi""")
def security_weekly_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = awards(spark, sf_dir).where(bands.plausible(F.col("lakh"), F.col("security_lakh")))
    r = lambda c, k=4: F.round(c, k).alias(c)
    return bands.weekly_bands(bands.weekly_misses(ok, 12)).select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", r("lo"), r("hi"), r("coverage", 3), r("mape"), r("width", 3))


@query(f"""{_A}, {_PAIRS}, o AS (SELECT *, ln(ratio) AS r, row_number() OVER (ORDER BY signed_on, tender_id, line, part, bidder_id) - 1 AS i, count(*) OVER () AS n FROM pairs),
g AS (SELECT method, r FROM o WHERE i < n // 2 UNION ALL SELECT NULL, r FROM o WHERE i < n // 2), q AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY method) AS m FROM g),
s AS (SELECT *, 0.5::DOUBLE * (m - 1) AS c, greatest(0.0, 0.1::DOUBLE * (m + 1) / m) * (m - 1) AS l, least(1.0, 0.9::DOUBLE * (m + 1) / m) * (m - 1) AS h FROM q),
f AS (SELECT method, max(m) AS m, sum(r * greatest(0, 1 - abs(k - c))) AS centre, sum(r * greatest(0, 1 - abs(k - l))) AS lo, sum(r * greatest(0, 1 - abs(k - h))) AS hi FROM s GROUP BY 1),
t AS (SELECT o.signed_on, o.r, coalesce(f.centre, p.centre) AS centre, coalesce(f.lo, p.lo) AS lo, coalesce(f.hi, p.hi) AS hi FROM o LEFT JOIN (SELECT * FROM f WHERE m >= 50 AND method IS NOT NULL) f ON o.method = f.method, (SELECT * FROM f WHERE method IS NULL) p WHERE o.i >= o.n // 2)
SELECT (SELECT count(*) FROM pairs) AS n, round((SELECT median(ratio) FROM pairs), 4) AS median_ratio, round((SELECT median(abs(1 / ratio - 1)) FROM pairs), 4) AS raw_error, count(*) AS n_test, min(signed_on) AS test_from,
round(median(abs(exp(centre - r) - 1)), 4) AS mape, round(avg((r BETWEEN lo AND hi)::INT), 4) AS coverage, round(median(exp(hi - lo)), 3) AS width FROM t""")
def plan_half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bands.plan_halves(_plan_pairs(spark, sf_dir).select("tender_id", "line", "part", "bidder_id", "method", "signed_on", "ratio"), ["signed_on", "tender_id", "line", "part", "bidder_id"])
    r = lambda c, k=4: F.round(c, k).alias(c)
    return out.select("n", r("median_ratio"), r("raw_error"), "n_test", "test_from", r("mape"), r("coverage"), r("width", 3))


_SRC = "CASE WHEN method = '1-URGENT' THEN 'portal' WHEN method = '2-HIGH' THEN 'model' ELSE '' END"


@query(f"{_T} SELECT count(*) AS live, round(avg(({_SRC} = 'portal')::INT), 4) AS portal_share, round(avg(({_SRC} = 'model')::INT), 4) AS model_share FROM tenders WHERE status = 'Live'")
def category_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("method") == "1-URGENT", "portal").when(F.col("method") == "2-HIGH", "model").otherwise("")
    return evaluate.category_sources(tenders(spark, sf_dir).withColumn("category_source", source))


@query(f"""WITH {_FIG}, b AS (SELECT figure, arg_max(value, run) AS now, max(value) - min(value) AS spread FROM runs GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY figure) AS i FROM b)
SELECT 1 AS line, '# Accuracy' AS text UNION ALL SELECT 2, '' UNION ALL SELECT 3, '| Figure | Now | Spread |' UNION ALL SELECT 4, '|---|---|---|' UNION ALL SELECT 4 + i, '| ' || replace(figure, '_', ' ') || ' | ' || printf('%.4f', now) || ' | ' || printf('%.4f', spread) || ' |' FROM o""")
def accuracy_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a training run writes, a row a line."""
    f = _figures(spark, sf_dir).groupBy("figure").agg(F.max_by("value", "run").alias("now"), (F.max("value") - F.min("value")).alias("spread"))
    return report.lines(report.accuracy_page(f))


@query(f"""WITH {_FIG}, b AS (SELECT figure, arg_max(value, run) AS now FROM runs GROUP BY 1) SELECT count(*) AS lines, CAST(sum((figure < 'C')::INT) AS BIGINT) AS edited, sum((figure < 'C')::INT) = 0 AS same FROM b""")
def report_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that is written again against the stored one, of which some lines were edited by hand."""
    now = _figures(spark, sf_dir).groupBy("figure").agg(F.max_by("value", "run").alias("now"))
    made = now.select(F.col("figure").alias("line"), F.format_string("%.4f", "now").alias("text"))
    stored = made.withColumn("text", F.when(F.col("line") < "C", F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
    return report.compared(made, stored)


_Q = "r AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS name, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no at sign' ELSE 'c' || c_custkey || '@example.org' END AS email, repeat(c_mktsegment, CAST(c_custkey % 300 AS INT)) AS message, CASE WHEN c_custkey % 11 = 0 THEN 'filled' ELSE '' END AS trap FROM customer)"


@query(f"""WITH {_Q} SELECT c_custkey, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'name' END, CASE WHEN NOT regexp_matches(coalesce(email, ''), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email' END, CASE WHEN length(message) > 2000 THEN 'message' END, CASE WHEN trap <> '' THEN 'trap' END], lambda x: x IS NOT NULL), '|') AS faults FROM r""")
def access_request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with requests for access; customers stand for those who ask."""
    key = F.col("c_custkey")
    rest = lambda n: F.pmod(key, F.lit(n))
    email = F.when(rest(5) == 0, F.lit(None).cast("string")).when(rest(5) == 1, "no at sign").otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org")))
    faults = serve.request_faults(F.when(rest(7) == 0, " ").otherwise(F.col("c_name")), email, F.repeat("c_mktsegment", rest(300).cast("int")), F.when(rest(11) == 0, "filled").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(faults, "|").alias("faults"))


@query("""WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_id % 10 IN (4, 7)) SELECT CAST(c_custkey AS VARCHAR) AS sub_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM f)""")
def subscriptions_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions that stay after endpoints were found gone; events stand for failures, with codes from 400 to 410."""
    code = F.when(F.pmod("event_id", F.lit(10)) == 7, 410).otherwise(400 + F.pmod("event_id", F.lit(10))).cast("int")
    failures = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sub_id"), code.alias("code"))
    return alerts.pruned(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sub_id")), failures)


@query()
def history_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history route over all awards, from title and date alone: bands calibrated on the last fifth by date, by method."""
    a = awards(spark, sf_dir).where("lakh > 0").select("tender_id", "line", "part", "bidder_id", "method", F.col("district").alias("category"), F.col("pe_id").alias("ministry"), "signed_on", "lakh", F.concat_ws(" ", "awardee", F.col("part").cast("string"), F.lit("sets 2024-2025")).alias("title"))
    rows = history.features(a.withColumn("y", F.log1p("lakh"))).withColumn("text_score", F.lit(0.0))
    primed = bands.expanding_prior(rows, ["ministry", "method"], "y", ["signed_on", "tender_id", "line", "part", "bidder_id"], 10.0)
    median, difficulty, edges = history.trained(primed.withColumn("history", F.log1p("history")), trees=3)
    return edges.select("method", "n", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))
