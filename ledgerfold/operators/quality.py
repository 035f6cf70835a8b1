"""Gates and invariants: a model is promoted only if it is no worse than noise, a pipeline passes only if its tables agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tolerance where no noise was measured, and how many typical steps count as noise.
TOLERANCE, MULTIPLE_TOLERANCE, STEPS = 0.02, 0.5, 3.0
COVERED, MOST_LAKH = 0.95, 500_000.0


def breaches(before: DataFrame, now: DataFrame, noise: DataFrame) -> DataFrame:
    """Figures lost by more than they have moved before: (figure, better, was, now, lost, tolerated).

    ``before``, ``now``: (figure, value); ``noise``: (figure, better, kind, typical_step, spread). Figures that either side lacks pass.
    """
    steps = F.when(F.col("typical_step") > 0, STEPS * F.col("typical_step"))
    spread = F.when(F.col("spread") > 0, F.col("spread"))
    tolerated = F.coalesce(F.greatest(steps, spread), F.when(F.col("kind") == "multiple", MULTIPLE_TOLERANCE).otherwise(TOLERANCE))
    joined = noise.join(before.select("figure", F.col("value").alias("was")), "figure").join(now.select("figure", F.col("value").alias("now")), "figure")
    lost = F.when(F.col("better") == "up", F.col("was") - F.col("now")).otherwise(F.col("now") - F.col("was"))
    return joined.withColumn("lost", lost).withColumn("tolerated", tolerated).where("lost > tolerated").select("figure", "better", *(F.round(c, 4).alias(c) for c in ("was", "now", "lost", "tolerated")))


def movement(net: Column, typical: Column, better: Column) -> Column:
    """``noise``, ``better`` or ``worse``."""
    return F.when(F.abs(net) <= STEPS * typical, "noise").when((net > 0) == (better == "up"), "better").otherwise("worse")


def merged_metrics(own: DataFrame, dedicated: DataFrame) -> DataFrame:
    """(figure, value): a dedicated evaluation's figures where it has them."""
    return own.join(dedicated.select("figure", F.col("value").alias("__d")), "figure", "full").select("figure", F.coalesce("__d", "value").alias("value"))


def invariants(tenders: DataFrame, predictions: DataFrame, rejected: DataFrame) -> DataFrame:
    """(name, seen, failed) of every check; a pipeline passes if none failed."""
    live = tenders.where("status = 'Live'").select("tender_id", "category_source")
    t = live.agg(F.count_if(F.col("category_source") != "portal").alias("untagged"), F.count_if(F.col("category_source") == "model").alias("modelled"), F.count(F.lit(1)).alias("live"))
    p = predictions.agg(F.count_if((F.col("q10_lakh") > F.col("q50_lakh")) | (F.col("q50_lakh") > F.col("q90_lakh"))).alias("crossed"), F.count_if(F.col("q50_lakh") > MOST_LAKH).alias("huge"), F.count(F.lit(1)).alias("bands"))
    c = live.join(predictions.select("tender_id").distinct(), "tender_id", "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    r = rejected.agg(F.count(F.lit(1)).alias("rejected"))
    one = t.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(r))  # one row each
    row = lambda name, seen, failed: F.struct(F.lit(name).alias("name"), seen.cast("bigint").alias("seen"), failed.alias("failed"))
    checks = F.array(
        row("rejected_models", F.col("rejected"), F.col("rejected") > 0), row("uncategorised", F.col("modelled"), (F.col("untagged") > 0) & (F.col("modelled") == 0)),
        row("coverage", F.col("covered"), F.col("covered") < COVERED * F.col("live")), row("band_order", F.col("crossed"), F.col("crossed") > 0), row("band_size", F.col("huge"), F.col("huge") > 0),
    )
    return one.select(F.explode(checks).alias("c")).select("c.*")


def truth_coverage(tagged: DataFrame, labelled: DataFrame) -> DataFrame:
    """(n_tagged, truth_coverage): how many tagged tenders yield a label."""
    marked = tagged.select("tender_id").distinct().join(labelled.where("sector is not null").select("tender_id").distinct().withColumn("__y", F.lit(1)), "tender_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("n_tagged"), F.round(F.avg(F.coalesce("__y", F.lit(0)).cast("double")), 4).alias("truth_coverage"))
