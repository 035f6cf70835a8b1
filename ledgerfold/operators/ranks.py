"""Exact ranks and quantiles within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.storage import saved, sent, unused

#: Bins to a unit of log(1 + |value|).
BINS = 4096


def ranked(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``df`` with ``__i`` (place from 0 by ``value`` within the group) and ``__n`` (rows of the group); null values are left out.

    Rows are dealt by ranges of (groups, value), so a large group lies in many partitions: each ranks its own part, and the counts of the
    parts, a few for each group, say how many stand before it.
    """
    keys = [*groups, "__part"]
    dealt = saved(df.where(F.col(value).isNotNull()).repartitionByRange(*groups, value).withColumn("__part", F.spark_partition_id()), "ranked")
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = F.sum("__k").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k")).withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__n", F.sum("__k").over(whole))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in keys]
    joined = dealt.alias("d").join(counts.alias("c"), on).select("d.*", "c.__before", "c.__n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    return joined.withColumn("__i", F.col("__before") + place).drop("__before", "__part")


def running(df: DataFrame, groups: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with one column for each of ``values``: its sum over the rows of the group before this one by ``order``, 0 for the first.

    As in ``ranked``, rows are dealt by ranges of (groups, order): each part adds up its own rows, and the sums of the parts, a few for each
    group, say what stands before it. Rows that are equal by ``order`` lie in one part.
    """
    at = unused(df.columns, "part")
    own = {name: unused([*df.columns, at], f"own_{name}") for name in values}
    dealt = saved(df.withColumns({own[n]: c for n, c in values.items()}).repartitionByRange(*groups, *order).withColumn(at, F.spark_partition_id()), "running")
    whole = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*groups, at).agg(*(F.sum(c).alias(c) for c in own.values()))
    before = sums.select(*groups, at, *(F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"before_{c}") for c in own.values()))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*groups, at]]
    joined = dealt.alias("d").join(before.alias("b"), on).select("d.*", *(f"b.before_{c}" for c in own.values()))
    inside = Window.partitionBy(*groups, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*df.columns, *((F.col(f"before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in own.items()))


def binned(value: Column) -> Column:
    """A whole number that never falls as ``value`` grows; NaN is last, as in a sort."""
    v = value.cast("double")
    return F.when(F.isnan(v), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * BINS))


def quantiles(df: DataFrame, groups: list[str], value: str, levels: dict[str, Column], keys: list[str] | None = None, spread: Callable[[DataFrame], DataFrame] | None = None, stored: bool = False) -> DataFrame:
    """(groups, n, one column a level): linear quantiles at levels that may depend on ``__n``, exact for groups of any size.

    Rows are first counted by bins of their value, which says in what bins the two places of a level lie; only values of these bins are ranked,
    each with its count. Rows may belong to several groups: they then have ``keys``, and ``spread`` turns rows of (keys, __bin, __c and maybe
    __v) into those of (groups, the same), for counts as for values. ``df`` is read twice, so it is written down unless it is ``stored``.
    """
    keys, turned = (groups, lambda d: d) if spread is None else (keys or [], spread)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    rows = (rows if stored else saved(rows, "values")).withColumn("__bin", binned(F.col("__v")))
    counted = lambda d, by: d.groupBy(*by).agg(F.sum("__c").alias("__c"))
    counts = counted(turned(rows.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c"))), [*groups, "__bin"])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))  # bins, not rows
    before = F.sum("__c").over(whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("__n", F.sum("__c").over(whole)).withColumn("__before", F.coalesce(before, F.lit(0)))
    at = {name: level * (F.col("__n") - 1) for name, level in levels.items()}
    within = lambda place: (place >= F.col("__before")) & (place < F.col("__before") + F.col("__c"))
    wanted = F.lit(False)
    for pos in at.values():
        wanted = wanted | within(F.floor(pos)) | within(F.floor(pos) + 1)
    chosen = sent(placed.where(wanted).drop("__c"), "chosen")
    # Values of the bins that any group needs, then those that their group needs.
    rest = rows.join(sent(chosen.select("__bin").distinct(), "bins"), "__bin", "left_semi")
    rest = turned(rest.groupBy(*keys, "__bin", "__v").agg(F.count(F.lit(1)).alias("__c"))).alias("d")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*groups, "__bin"]]
    rest = counted(rest.join(chosen.alias("c"), on).select("d.*", "c.__n", "c.__before"), [*groups, "__bin", "__n", "__before", "__v"])
    held = running(rest, [*groups, "__bin"], ["__v"], {"__in": F.col("__c")}).withColumn("__before", F.col("__before") + F.col("__in"))
    parts = []
    for name, pos in at.items():
        weights = [(place, F.greatest(F.lit(0.0), 1 - F.abs(place - pos))) for place in (F.floor(pos), F.floor(pos) + 1)]
        lower, upper = (F.when(within(place) & (weight > 0), weight * F.col("__v")).otherwise(F.lit(0.0)) for place, weight in weights)
        parts.append(F.sum(lower + upper).alias(name))
    return held.groupBy(*groups).agg(F.max("__n").alias("n"), *parts)
