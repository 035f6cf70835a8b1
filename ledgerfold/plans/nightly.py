"""The nightly batch: raw lake to clean tables with entities, categories, profiles and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.scalars import entity_id, repaired_value
from ledgerfold.operators import labels, profiles, resolve
from ledgerfold.sources import lake

BIDDER_AWARDS, ENTITY_AWARDS = 50, 10


def build(spark: SparkSession, root: str, today: str, decided: DataFrame | None = None, tagged: DataFrame | None = None, predicted: DataFrame | None = None, bar: float = 0.6) -> dict[str, int]:
    """Writes tenders, contracts, bidders and procuring_entities under ``root``/clean; how many rows each has.

    ``tagged``: (tender_id, category) from codes; ``predicted``: (tender_id, category, conf) from the classifier.
    """
    tenders, contracts = lake.load_all(spark, root, "tenders"), lake.load_all(spark, root, "contracts")
    tagged = tagged if tagged is not None else spark.createDataFrame([], "tender_id string, category string")
    predicted = predicted if predicted is not None else spark.createDataFrame([], "tender_id string, category string, conf double")
    named, entities, _ = resolve.resolve(contracts.groupBy(F.col("awardee").alias("name")).agg(F.count(F.lit(1)).alias("n_rows")), decided)
    with_pe = lambda df: df.withColumn("pe_id", entity_id(F.lower(F.btrim("procuring_entity")), "pe:"))
    clean_tenders = labels.by_source(with_pe(tenders), tagged, predicted, bar)
    repaired = with_pe(contracts.withColumn("value_crore", repaired_value(F.col("value_crore"))))
    bidder = named.select(F.col("name").alias("awardee"), F.col("entity_id").alias("bidder_id"))
    clean_contracts = labels.by_source(repaired.join(bidder, "awardee", "left").fillna({"bidder_id": ""}), tagged, predicted, bar)
    lake.write_clean(clean_tenders, root, "tenders")
    lake.write_clean(clean_contracts, root, "contracts")
    t, c = spark.read.parquet(f"{root}/clean/tenders.parquet"), spark.read.parquet(f"{root}/clean/contracts.parquet")

    since = F.date_format(F.date_sub(F.lit(today).cast("date"), 365), "yyyy-MM-dd")
    held = c.where("bidder_id <> ''")
    no_bands = spark.createDataFrame([], "tender_id string, q10_lakh double, q90_lakh double")
    fields = ["tender_id", "title", "procuring_entity", "signed_on", "value_crore"]
    names = entities.select(F.col("entity_id").alias("bidder_id"), "canonical_name", F.to_json("variants").alias("variants"))
    bidders = profiles.clean_bidders(profiles.bidder_stats(c), names, profiles.recent_awards(held, "bidder_id", fields, BIDDER_AWARDS, ["tender_id"]), profiles.flags_json(profiles.dependence(c, no_bands, since), "bidder_id"))
    places = profiles.entity_counts(t, c).join(profiles.recent_awards(c, "pe_id", ["tender_id", "title", "awardee", "signed_on", "value_crore"], ENTITY_AWARDS, ["tender_id"]), "pe_id", "left")
    places = places.join(profiles.as_json(profiles.top_bidders(c)), "pe_id", "left").join(profiles.flags_json(profiles.concentration(c, since), "pe_id"), "pe_id", "left")
    lake.write_clean(bidders, root, "bidders")
    lake.write_clean(places.fillna({"recent_awards": "[]", "top_bidders": "[]", "flags": "{}"}), root, "procuring_entities")
    return {name: spark.read.parquet(f"{root}/clean/{name}.parquet").count() for name in ("tenders", "contracts", "bidders", "procuring_entities")}
