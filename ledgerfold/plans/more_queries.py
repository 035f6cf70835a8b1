"""Queries over shares, picks and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import evaluate, labels, load, quality, setops
from ledgerfold.plans.catalog import query
from ledgerfold.plans.frames import AWARDS_SQL, TENDERS_SQL, awards, table, tenders
from ledgerfold.plans.model_queries import _BANDED, _FIG, _FIGURES, _banded, _figures
from ledgerfold.sources import lake

_T, _A, _TA = f"WITH {TENDERS_SQL}", f"WITH {AWARDS_SQL}", f"WITH {TENDERS_SQL}, {AWARDS_SQL}"
_LIVE = "live AS (SELECT method, CASE WHEN CAST(tender_id AS BIGINT) % 3 = 0 THEN NULL WHEN method = '5-LOW' THEN 0.0 ELSE estimate END AS security_bdt FROM tenders WHERE status = 'Live')"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir).where("status = 'Live'")
    security = F.when(F.pmod(F.col("tender_id").cast("bigint"), F.lit(3)) == 0, F.lit(None).cast("double")).when(F.col("method") == "5-LOW", 0.0).otherwise(F.col("estimate"))
    return t.select("tender_id", "method", security.alias("security_bdt"))


@query(f"{_T}, {_LIVE} SELECT method, count(*) AS n, count(*) FILTER (coalesce(security_bdt, 0) <= 0) AS without, round(count(*) FILTER (coalesce(security_bdt, 0) <= 0) / sum(count(*) FILTER (coalesce(security_bdt, 0) <= 0)) OVER (), 4) AS share FROM live GROUP BY 1")
def live_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.live_mix(_live(spark, sf_dir))


@query(f"{_T}, {_LIVE} SELECT count(*) AS live, round(avg((coalesce(security_bdt, 0) > 0)::INT), 4) AS share FROM live")
def security_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.security_share(_live(spark, sf_dir))


@query(f"""{_A}, f AS (SELECT method, {_FIGURES} FROM ({_BANDED}) GROUP BY 1), m AS (SELECT l_linestatus AS s, l_returnflag AS method, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 4) AS share FROM lineitem GROUP BY 1, 2)
SELECT round(sum(coverage * share) / sum(share), 4) AS coverage, round(sum(mape * share) / sum(share), 4) AS mape, round(sum(width * share) / sum(share), 4) AS width FROM f JOIN m USING (method) WHERE s = 'O'""")
def live_mix_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = awards(spark, sf_dir).where("district = 'O'").select("method", F.lit(0.0).alias("security_bdt"))
    return evaluate.projected(evaluate.coverage_by(_banded(spark, sf_dir), ["method"]), evaluate.live_mix(mix).select("method", "share"))


@query(f"{_TA} SELECT CAST(max(CAST(tender_id AS BIGINT)) AS BIGINT) AS newest, count(*) FILTER (tender_id IN (SELECT tender_id FROM awards)) AS with_award FROM tenders")
def newest_and_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir)
    have = t.join(awards(spark, sf_dir).select("tender_id").distinct(), "tender_id", "left_semi").agg(F.count(F.lit(1)).alias("with_award"))
    return t.agg(lake.newest_id(t).alias("newest")).crossJoin(F.broadcast(have))  # one row


@query("SELECT sum(weight) FILTER (done) AS done, sum(weight) AS total, round(sum(weight) FILTER (done) / sum(weight), 4) AS share FROM (SELECT CAST(p_size AS BIGINT) AS weight, p_partkey % 4 < 3 AS done FROM part)")
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.task_progress(table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("weight"), (F.pmod("p_partkey", F.lit(4)) < 3).alias("done")))


@query("""WITH tagged AS (SELECT DISTINCT p_partkey % 300 AS tender_id FROM part), labelled AS (SELECT DISTINCT p_partkey % 300 AS tender_id FROM part WHERE p_size > 25)
SELECT count(*) AS n_tagged, round(avg((l.tender_id IS NOT NULL)::INT), 4) AS truth_coverage FROM tagged t LEFT JOIN labelled l ON t.tender_id = l.tender_id""")
def truth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(300)).alias("tender_id"), F.when(F.col("p_size") > 25, "x").alias("sector"))
    return quality.truth_coverage(p, p)


@query(f"""WITH {_FIG}, s AS (SELECT figure, arg_max(value, run) - arg_min(value, run) AS net FROM runs GROUP BY 1)
SELECT figure, CASE WHEN abs(net) <= 0.06 THEN 'noise' WHEN (net > 0) = (length(figure) % 2 = 0) THEN 'better' ELSE 'worse' END AS movement FROM s""")
def movement_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _figures(spark, sf_dir).groupBy("figure").agg((F.max_by("value", "run") - F.min_by("value", "run")).alias("net"))
    better = F.when(F.pmod(F.length("figure"), F.lit(2)) == 0, "up").otherwise("down")
    return net.select("figure", quality.movement(F.col("net"), F.lit(0.02), better).alias("movement"))


@query(f"WITH {_FIG} SELECT figure, CASE WHEN d.value IS NOT NULL THEN d.value ELSE o.value END AS value FROM (SELECT * FROM runs WHERE run = 2) o FULL JOIN (SELECT * FROM runs WHERE run = 3 AND figure < 'F') d USING (figure)")
def metrics_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _figures(spark, sf_dir)
    return quality.merged_metrics(f.where("run = 2").select("figure", "value"), f.where("run = 3 and figure < 'F'").select("figure", "value"))


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_suppkey % 10 = 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return load.inserted(s, s.where(F.pmod("s_suppkey", F.lit(3)) == 0).unionByName(s.where(F.pmod("s_suppkey", F.lit(10)) == 1).withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)), ["s_suppkey"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return load.deleted(table(spark, sf_dir, "supplier"), gone).select("s_suppkey", "s_name")


@query(f"{_T} SELECT tender_id, CASE category WHEN 'machinery' THEN 'Machines and parts' WHEN 'building' THEN 'Building work' ELSE replace(category, '_', ' ') END AS label, category = 'machinery' OR category IN ('automobile', 'building') AS under_machinery FROM tenders")
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = labels.shown_label(F.col("category"), {"machinery": "Machines and parts", "building": "Building work"})
    return tenders(spark, sf_dir).select("tender_id", shown.alias("label"), labels.hierarchy_match(F.col("category"), F.lit("machinery"), {"machinery": ["automobile", "building"]}).alias("under_machinery"))


@query()
def held_out_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.round(F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 1000.0, 3).alias("conf"), (F.pmod("doc_id", F.lit(9)) > 0).alias("correct"))
    return evaluate.held_out_bar(rows, "doc_id", 0.85)


@query(f"{_T} SELECT tender_id, status FROM tenders ORDER BY md5('7:' || tender_id), tender_id LIMIT 50")
def seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.seeded_pick(tenders(spark, sf_dir).select("tender_id", "status"), "tender_id", 50, 7)


@query("SELECT user_id, count(*) AS n, round(max(value), 4) AS most FROM events WHERE event_type <> 'x' GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, user_id LIMIT 40")
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").where("event_type <> 'x'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("most"))
    return per.where("n >= 3").orderBy(F.desc("n"), "user_id").limit(40)


@query("""WITH s AS (SELECT l_returnflag, list(DISTINCT l_suppkey) AS held FROM lineitem WHERE l_quantity >= 40 GROUP BY 1), j AS (SELECT a.l_returnflag AS one, b.l_returnflag AS two, a.held AS x, b.held AS y FROM s a JOIN s b ON a.l_returnflag < b.l_returnflag)
SELECT one, two, len(list_filter(x, lambda k: NOT list_contains(y, k))) AS only_one, len(list_filter(y, lambda k: NOT list_contains(x, k))) AS only_two, len(list_intersect(x, y)) AS both,
len(list_filter(x, lambda k: NOT list_contains(y, k))) = 0 AS is_subset, len(list_filter(x, lambda k: NOT list_contains(y, k))) = 0 AND len(list_filter(y, lambda k: NOT list_contains(x, k))) = 0 AS equal FROM j""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, intersection, subset and equality of the sets of bidders that each flag has, as semi and anti joins of distinct rows."""
    held = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("member")).distinct()
    return setops.compared(held, "flag", "member")
