"""Sets of named groups against each other, without holding a set in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(one, two, only_one, only_two, both, is_subset, equal) of each pair of groups, from distinct (group, member).

    ``is_subset``: whether ``one`` lies in ``two``. Members meet by an equi-join; a difference is a size less the intersection.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    a, b = (rows.select(F.col(group).alias(g), F.col(member)) for g in ("one", "two"))
    met = a.join(b, member).where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("both"))
    one, two = (sizes.select(F.col(group).alias(g), F.col("n").alias(f"n_{g}")) for g in ("one", "two"))
    # A few groups; their members are not looked at here.
    pairs = one.join(F.broadcast(two), F.col("one") < F.col("two")).join(met, ["one", "two"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    out = pairs.select("one", "two", (F.col("n_one") - F.col("both")).alias("only_one"), (F.col("n_two") - F.col("both")).alias("only_two"), "both")
    return out.withColumn("is_subset", F.col("only_one") == 0).withColumn("equal", (F.col("only_one") == 0) & (F.col("only_two") == 0))
