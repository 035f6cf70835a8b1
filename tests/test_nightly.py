from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerfold.operators import history
from ledgerfold.plans import nightly
from ledgerfold.sources import lake


def test_build(spark, tmp_path):
    root = str(tmp_path)
    t = [("1", "Live", "Roads", "PE one"), ("2", "Closed", "Roads", "PE one"), ("3", "Live", "Health", "PE two")]
    lake.append(spark.createDataFrame([(*r, "Supply", "2026-09-01T10:00") for r in t], "tender_id string, status string, ministry string, procuring_entity string, title string, published_at string"), root, "tenders", "20260913T000000000000Z")
    c = [("11", "M/S. Sawda Traders", "2026-09-02", 0.5), ("12", "Sawda Traders", "2026-09-03", 1.0), ("13", "Rahim Enterprise", "2026-09-01", 9_000_000.0), ("14", "", "2026-09-01", 0.2)]
    lake.append(spark.createDataFrame([(*r, "Roads", "PE one") for r in c], "tender_id string, awardee string, signed_on string, value_crore double, ministry string, procuring_entity string"), root, "contracts", "20260913T000000000000Z")
    tagged = spark.createDataFrame([("1", "roads")], "tender_id string, category string")
    for _ in range(2):
        counts = nightly.build(spark, root, "2026-09-13", tagged=tagged)
    assert counts == {"tenders": 3, "contracts": 4, "bidders": 2, "procuring_entities": 2}
    b = {r["canonical_name"]: r for r in spark.read.parquet(f"{root}/clean/bidders.parquet").collect()}
    s = b["M/S. Sawda Traders"]
    assert (s["n_awards"], s["total_value_crore"], s["first_award"], s["last_award"]) == (2, 1.5, "2026-09-02", "2026-09-03")
    assert [x["tender_id"] for x in json.loads(s["recent_awards"])] == ["12", "11"] and json.loads(s["flags"])["awards_12m"] == 2
    assert b["Rahim Enterprise"]["total_value_crore"] == 0.9
    p = {r["name"]: r for r in spark.read.parquet(f"{root}/clean/procuring_entities.parquet").collect()}
    assert (p["PE one"]["n_contracts"], p["PE one"]["n_tenders"], p["PE two"]["n_contracts"]) == (4, 2, 0) and p["PE two"]["top_bidders"] == "[]"
    assert {r["bidder_id"] for r in spark.read.parquet(f"{root}/clean/contracts.parquet").where("awardee = ''").collect()} == {""}
    one = spark.read.parquet(f"{root}/clean/tenders.parquet").where("tender_id = '1'").first()
    assert (one["category"], one["category_source"], one["category_confidence"]) == ("roads", "portal", 1.0)


def test_empty_lake(spark, tmp_path):
    assert set(nightly.build(spark, str(tmp_path), "2026-09-13").values()) == {0}


def test_history_route(spark):
    n = 1200
    base = spark.range(n).select(
        F.col("id").cast("string").alias("tender_id"), F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("id") / 4).cast("int")), "yyyy-MM-dd").alias("signed_on"), F.when(F.col("id") % 3 == 0, "OTM").otherwise("LTM").alias("method"),
        F.lit("c").alias("category"), F.lit("m").alias("ministry"), F.concat(F.lit("Supply of "), (F.col("id") % 7).cast("string"), F.lit(" sets")).alias("title"), (F.log(1 + F.col("id") % 7) + F.pmod(F.xxhash64("id"), F.lit(100)) / 200.0).alias("y"),
    ).withColumns({"history": F.lit(3.0), "prior": F.lit(1.0)})
    rows, text = history.stacked(history.features(base))
    rows = rows.cache()
    median, difficulty, edges = history.trained(rows, trees=8)
    scored = difficulty.transform(median.transform(rows).select(*rows.columns, "y_hat").withColumn("miss_size", F.lit(0.0)))
    out = history.banded_prediction(scored.drop("__f"), edges, F.col("miss_size_hat"))
    r = out.agg(F.avg(F.log("q50") - F.col("y")).alias("bias"), F.avg((F.exp("y").between(F.col("q10"), F.col("q90"))).cast("double")).alias("inside"), F.count_if(F.col("q10") > F.col("q50")).alias("crossed")).first()
    assert abs(r["bias"]) < 0.2 and 0.65 < r["inside"] < 0.95 and r["crossed"] == 0
    assert "text_score" in text.transform(base).columns
    days = {r["signed_on"] for r in rows.where(F.col("signed_on") <= history.cut_date(rows)).select("signed_on").collect()}
    assert 0.78 * n < rows.where(F.col("signed_on").isin(*days)).count() < 0.83 * n


def test_drift_and_pads(spark):
    rows = spark.range(1000).select((F.col("id") / 1000.0 - 0.5).alias("r"), F.lit(-0.3).alias("lo"), F.lit(0.3).alias("hi"))
    assert abs(history.drift(rows) - 1.35) < 0.051
    c = spark.range(400).select(F.lit("m").alias("method"), (F.col("id") / 400.0).alias("y"), F.lit(0.4).alias("lo"), F.lit(0.6).alias("hi"))
    got = {r["method"]: r["pad"] for r in history.cqr_pad(c).collect()}
    assert set(got) == {"m", None} and abs(got["m"] - 0.3) < 0.01
