"""Profiles of bidders and buying entities: counts, latest awards, leading bidders, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Awards in the window from which notes are made, and the shares that make them.
NOTE_AWARDS, NOTE_TOP, NOTE_HHI, NOTE_ENTITY = 5, 0.5, 0.4, 0.7
#: An award is outside its band beyond so many times an edge.
OUTSIDE = 3.0


def in_window(awards: DataFrame, since: str | Column) -> DataFrame:
    """Awards with a bidder, signed from ``since`` on; no date is outside."""
    since = F.lit(since) if isinstance(since, str) else since
    return awards.where((F.coalesce("bidder_id", F.lit("")) != "") & (F.coalesce("signed_on", F.lit("")) >= since))


def bidder_stats(awards: DataFrame) -> DataFrame:
    """(bidder_id, n_awards, total_value_crore, first_award, last_award)."""
    return awards.where(F.coalesce("bidder_id", F.lit("")) != "").groupBy("bidder_id").agg(
        F.count(F.lit(1)).alias("n_awards"), F.sum(F.coalesce("value_crore", F.lit(0.0))).alias("total_value_crore"), F.min("signed_on").alias("first_award"), F.max("signed_on").alias("last_award")
    )


def recent_awards(awards: DataFrame, group: str, fields: list[str], k: int, ties: list[str]) -> DataFrame:
    """(group, recent_awards): the ``k`` latest awards of each group, as JSON with nulls kept."""
    w = Window.partitionBy(group).orderBy(F.col("signed_on").desc_nulls_last(), *ties)
    top = awards.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__n", F.struct(*fields).alias("award")))), lambda x: x["award"])
    return top.groupBy(group).agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("recent_awards"))


def top_bidders(awards: DataFrame, k: int = 10) -> DataFrame:
    """(pe_id, place, bidder_id, name, n, value) of each entity's leading bidders; ``name`` is the commonest, the least of equals."""
    per = awards.where(F.coalesce("bidder_id", F.lit("")) != "").groupBy("pe_id", "bidder_id").agg(
        F.mode("awardee", True).alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("value_crore", F.lit(0.0))), 4).alias("value")
    )
    w = Window.partitionBy("pe_id").orderBy(F.desc("n"), F.desc("value"), "bidder_id")
    return per.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def as_json(top: DataFrame) -> DataFrame:
    """``top_bidders`` as one JSON list for each entity."""
    row = F.struct("place", F.struct("bidder_id", "name", "n", "value").alias("b"))
    return top.groupBy("pe_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["b"]), {"ignoreNullFields": "false"}).alias("top_bidders"))


def entity_counts(tenders: DataFrame, awards: DataFrame) -> DataFrame:
    """(pe_id, name, ministry, n_contracts, n_tenders) from both sides; name and ministry of most rows, the greater of equals."""
    count = lambda df, mine, other: df.groupBy("pe_id", F.col("procuring_entity").alias("name"), "ministry").agg(F.count(F.lit(1)).alias(mine)).withColumn(other, F.lit(0).cast("bigint"))
    both = count(awards, "n_contracts", "n_tenders").unionByName(count(tenders, "n_tenders", "n_contracts"))
    best = F.max_by(F.struct("name", "ministry"), F.struct(F.col("n_contracts") + F.col("n_tenders"), "name", "ministry")).alias("best")
    return both.groupBy("pe_id").agg(best, F.sum("n_contracts").alias("n_contracts"), F.sum("n_tenders").alias("n_tenders")).select("pe_id", "best.name", "best.ministry", "n_contracts", "n_tenders")


def concentration(awards: DataFrame, since: str | Column) -> DataFrame:
    """(pe_id, awards_12m, winners, top_bidder, top_bidder_id, top_share, top3_share, hhi, notes) of the window.

    One count for each entity and bidder; places and shares then need the few rows of an entity only.
    """
    by = in_window(awards, since).groupBy("pe_id", "bidder_id").agg(F.count(F.lit(1)).alias("k"), F.mode("awardee", True).alias("name"))
    total = Window.partitionBy("pe_id")
    placed = by.withColumn("n", F.sum("k").over(total)).withColumn("place", F.row_number().over(total.orderBy(F.desc("k"), "bidder_id"))).withColumn("share", F.col("k") / F.col("n"))
    first = F.col("place") == 1
    out = placed.groupBy("pe_id").agg(
        F.max("n").alias("awards_12m"), F.count(F.lit(1)).alias("winners"), F.max(F.when(first, F.col("name"))).alias("top_bidder"), F.max(F.when(first, F.col("bidder_id"))).alias("top_bidder_id"),
        F.max("share").alias("top"), F.sum(F.when(F.col("place") <= 3, F.col("share"))).alias("top3"), F.sum(F.col("share") * F.col("share")).alias("h"),
    )
    enough = F.col("awards_12m") >= NOTE_AWARDS
    led = F.when(enough & (F.col("top") >= NOTE_TOP), F.format_string("One bidder won %d percent of %d awards in the last 12 months", F.bround(F.col("top") * 100).cast("int"), "awards_12m"))
    few = F.when(enough & (F.col("h") >= NOTE_HHI) & (F.col("winners") > 1), F.format_string("Awards concentrated among %d winners (HHI %.2f)", "winners", "h"))
    return out.select("pe_id", "awards_12m", "winners", "top_bidder", "top_bidder_id", F.round("top", 4).alias("top_share"), F.round(F.least("top3", F.lit(1.0)), 4).alias("top3_share"), F.round("h", 4).alias("hhi"), F.array_compact(F.array(led, few)).alias("notes"))


def dependence(awards: DataFrame, bands: DataFrame, since: str | Column) -> DataFrame:
    """(bidder_id, awards_12m, entities, top_entity, top_entity_share, above_band, below_band, notes) of the window.

    ``bands``: (tender_id, q10_lakh, q90_lakh), one row a tender. No band is neither above nor below.
    """
    lakh = F.col("value_crore") * 100
    w = in_window(awards, since).join(bands.select("tender_id", "q10_lakh", "q90_lakh"), "tender_id", "left")
    by = w.groupBy("bidder_id", "pe_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.coalesce(lakh > F.col("q90_lakh") * OUTSIDE, F.lit(False))).alias("a"), F.count_if(F.coalesce(lakh < F.col("q10_lakh") / OUTSIDE, F.lit(False))).alias("b"))
    out = by.groupBy("bidder_id").agg(F.sum("k").alias("awards_12m"), F.count(F.lit(1)).alias("entities"), F.max("k").alias("most"), F.sum("a").alias("above_band"), F.sum("b").alias("below_band"), F.min_by("pe_id", F.struct(-F.col("k"), "pe_id")).alias("top_entity"))
    share = F.col("most") / F.col("awards_12m")
    one = F.when((F.col("awards_12m") >= NOTE_AWARDS) & (share >= NOTE_ENTITY), F.format_string("%d percent of its awards come from one entity (%d awards in 12 months)", F.bround(share * 100).cast("int"), "awards_12m"))
    outside = F.when(F.col("above_band") + F.col("below_band") > 0, F.format_string("%d award%s well above and %d well below the predicted band", "above_band", F.when(F.col("above_band") != 1, F.lit("s")).otherwise(F.lit("")), "below_band"))
    return out.select("bidder_id", "awards_12m", "entities", "top_entity", F.round(share, 4).alias("top_entity_share"), "above_band", "below_band", F.array_compact(F.array(one, outside)).alias("notes"))


def flags_json(flags: DataFrame, key: str) -> DataFrame:
    return flags.select(key, F.to_json(F.struct(*(c for c in flags.columns if c != key)), {"ignoreNullFields": "false"}).alias("flags"))


def regional_share(awards: DataFrame, least: int = 5) -> DataFrame:
    """(bidder_id, district, n, total, share): each bidder's main district, of bidders with ``least`` awards."""
    per = awards.groupBy("bidder_id", "district").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bidder_id")
    placed = per.withColumn("total", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "district")))
    return placed.where((F.col("place") == 1) & (F.col("total") >= least)).select("bidder_id", "district", "n", "total", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def breadth(awards: DataFrame, least: int = 5) -> DataFrame:
    """(bidder_id, n_awards, n_entities, n_methods): specialists have few of either, generalists many."""
    return awards.groupBy("bidder_id").agg(F.count(F.lit(1)).alias("n_awards"), F.countDistinct("pe_id").alias("n_entities"), F.countDistinct("method").alias("n_methods")).where(F.col("n_awards") >= least)


def newcomers(awards: DataFrame, since: str | Column) -> DataFrame:
    """Bidders whose first award is in the window."""
    since = F.lit(since) if isinstance(since, str) else since
    return bidder_stats(awards).where(F.col("first_award") >= since)


def clean_bidders(stats: DataFrame, names: DataFrame, recent: DataFrame, flags: DataFrame) -> DataFrame:
    """``names`` (bidder_id, canonical_name, variants) with stats, recent awards and flags; absent ones are 0, [] and {}."""
    out = names.join(stats, "bidder_id", "left").join(recent, "bidder_id", "left").join(flags, "bidder_id", "left")
    return out.fillna({"n_awards": 0, "total_value_crore": 0.0, "recent_awards": "[]", "flags": "{}"})
