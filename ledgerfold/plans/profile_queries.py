"""Queries over bidders and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import profiles
from ledgerfold.plans.catalog import query
from ledgerfold.plans.frames import AWARDS_SQL, SINCE_SQL, TENDERS_SQL, awards, tenders, windowed

_A, _TA = f"WITH {AWARDS_SQL}", f"WITH {TENDERS_SQL}, {AWARDS_SQL}"
_WIN = f"{_A}, w AS (SELECT * FROM awards WHERE signed_on >= {SINCE_SQL})"


def _year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(awards(spark, sf_dir))


@query(f"{_A} SELECT bidder_id, count(*) AS n_awards, round(sum(value_crore), 2) AS total_value_crore, min(signed_on) AS first_award, max(signed_on) AS last_award FROM awards GROUP BY 1")
def bidder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.bidder_stats(awards(spark, sf_dir)).withColumn("total_value_crore", F.round("total_value_crore", 2))


@query(f"""{_A}, p AS (SELECT *, row_number() OVER (PARTITION BY bidder_id ORDER BY signed_on DESC NULLS LAST, tender_id, line, part) AS n FROM awards)
SELECT bidder_id, '[' || string_agg('{{"tender_id":"' || tender_id || '","signed_on":"' || signed_on || '"}}', ',' ORDER BY n) || ']' AS recent_awards FROM p WHERE n <= 10 GROUP BY 1""")
def recent_awards_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.recent_awards(awards(spark, sf_dir), "bidder_id", ["tender_id", "signed_on"], 10, ["tender_id", "line", "part"])


@query(f"""{_A}, g AS (SELECT pe_id, bidder_id, min(awardee) AS name, count(*) AS n, round(sum(value_crore), 4) AS value FROM awards GROUP BY 1, 2)
SELECT pe_id, row_number() OVER (PARTITION BY pe_id ORDER BY n DESC, value DESC, bidder_id) AS place, bidder_id, name, n, round(value, 2) AS value FROM g QUALIFY place <= 10""")
def top_bidders_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_bidders(awards(spark, sf_dir)).select("pe_id", "place", "bidder_id", "name", "n", F.round("value", 2).alias("value"))


@query(f"""{_TA}, b AS (SELECT pe_id, procuring_entity AS name, ministry, 0 AS c, 1 AS t FROM tenders UNION ALL SELECT a.pe_id, t.procuring_entity, t.ministry, 1, 0 FROM awards a JOIN tenders t ON a.tender_id = t.tender_id)
SELECT pe_id, max(name) AS name, max(ministry) AS ministry, CAST(sum(c) AS BIGINT) AS n_contracts, CAST(sum(t) AS BIGINT) AS n_tenders FROM b GROUP BY pe_id""")
def entity_counts_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenders(spark, sf_dir)
    named = awards(spark, sf_dir).select("tender_id", "pe_id").join(t.select("tender_id", "procuring_entity", "ministry"), "tender_id")
    return profiles.entity_counts(t, named)


@query(f"""{_WIN}, b AS (SELECT pe_id, bidder_id, count(*) AS k, min(awardee) AS name FROM w GROUP BY 1, 2),
s AS (SELECT *, sum(k) OVER (PARTITION BY pe_id) AS n, row_number() OVER (PARTITION BY pe_id ORDER BY k DESC, bidder_id) AS place FROM b)
SELECT pe_id, CAST(max(n) AS BIGINT) AS awards_12m, count(*) AS winners, max(name) FILTER (place = 1) AS top_bidder, max(bidder_id) FILTER (place = 1) AS top_bidder_id, round(max(k / n), 4) AS top_share,
round(least(sum(k / n) FILTER (place <= 3), 1.0), 4) AS top3_share, round(sum((k / n) * (k / n)), 4) AS hhi, CAST(0 AS INTEGER) AS n_notes FROM s GROUP BY pe_id""")
def entity_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.concentration(_year(spark, sf_dir), F.col("since")).withColumn("n_notes", F.size("notes")).drop("notes")


@query(f"""{_WIN}, d AS (SELECT tender_id, min(estimate) / 4 AS lo, min(estimate) / 2 AS hi FROM awards GROUP BY 1),
b AS (SELECT bidder_id, pe_id, count(*) AS k, count(*) FILTER (value_crore * 100 > hi / 3) AS a, count(*) FILTER (value_crore * 100 < lo / 100 / 3) AS z FROM w JOIN d USING (tender_id) GROUP BY 1, 2),
s AS (SELECT *, sum(k) OVER (PARTITION BY bidder_id) AS n, row_number() OVER (PARTITION BY bidder_id ORDER BY k DESC, pe_id) AS place FROM b)
SELECT bidder_id, CAST(max(n) AS BIGINT) AS awards_12m, count(*) AS entities, max(pe_id) FILTER (place = 1) AS top_entity, round(max(k / n), 4) AS top_entity_share, CAST(sum(a) AS BIGINT) AS above_band, CAST(sum(z) AS BIGINT) AS below_band FROM s GROUP BY bidder_id""")
def bidder_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = _year(spark, sf_dir)
    bands = awards(spark, sf_dir).groupBy("tender_id").agg(F.min("estimate").alias("e")).select("tender_id", (F.col("e") / 4 / 100).alias("q10_lakh"), (F.col("e") / 2 / 9).alias("q90_lakh"))
    return profiles.dependence(year, bands, F.col("since")).drop("notes")


@query(f"""{_A}, d AS (SELECT bidder_id, district, count(*) AS n FROM awards GROUP BY 1, 2)
SELECT bidder_id, district, n, CAST(sum(n) OVER w AS BIGINT) AS total, round(n / sum(n) OVER w, 4) AS share FROM d WINDOW w AS (PARTITION BY bidder_id) QUALIFY row_number() OVER (PARTITION BY bidder_id ORDER BY n DESC, district) = 1 AND sum(n) OVER w >= 5""")
def regional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.regional_share(awards(spark, sf_dir))


@query(f"{_A} SELECT bidder_id, count(*) AS n_awards, count(DISTINCT pe_id) AS n_entities, count(DISTINCT method) AS n_methods FROM awards GROUP BY 1 HAVING count(*) >= 5")
def bidder_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.breadth(awards(spark, sf_dir))


@query(f"{_A} SELECT bidder_id, count(*) AS n_awards, round(sum(value_crore), 2) AS total_value_crore, min(signed_on) AS first_award, max(signed_on) AS last_award FROM awards GROUP BY 1 HAVING min(signed_on) >= '1992-02-01'")
def newcomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.newcomers(awards(spark, sf_dir), "1992-02-01").withColumn("total_value_crore", F.round("total_value_crore", 2))
