"""Value bands: the route over published securities, the route over plan estimates, and which of them serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.operators import ranks
from ledgerfold.storage import saved, sent

COVERAGE = 0.80
LOW, HIGH = (1 - COVERAGE) / 2, 1 - (1 - COVERAGE) / 2
#: Award over security that is believable; rows a method needs for its own median; weight of the fallback in a buyer's.
RATIO_LOW, RATIO_HIGH, METHOD_ROWS, SHRINK = 5.0, 300.0, 50, 10.0
#: Pairs a method needs for its own plan figures.
PLAN_ROWS = 50
#: A band that is wider than so many times, or a buyer of fewer awards without a category, is not shown.
DEFER_WIDTH, DEFER_HISTORY = 12.0, 3
#: Pairs scored before the plan route may serve, and coverage it must show.
PLAN_TESTED, PLAN_COVERAGE = 200, (0.75, 0.85)


def plausible(lakh: Column, security_lakh: Column) -> Column:
    return F.coalesce(F.try_divide(lakh, security_lakh).between(RATIO_LOW, RATIO_HIGH), F.lit(False))


def usable(value: Column, signed_on: Column) -> Column:
    """Whether an award can be learned from: it has a positive value and a day on which it was signed."""
    return (F.coalesce(value, F.lit(0.0)) > 0) & (F.coalesce(signed_on, F.lit("")) != "")


def banded(df: DataFrame, groups: list[str], value: str, **how) -> DataFrame:
    """(groups, n, centre, lo, hi): median and finite-sample quantiles of ``value``; ``how`` as in ``ranks.quantiles``."""
    n = F.col("__n")
    levels = {"centre": F.lit(0.5), "lo": F.greatest(F.lit(0.0), LOW * (n + 1) / n), "hi": F.least(F.lit(1.0), HIGH * (n + 1) / n)}
    return ranks.quantiles(df, groups, value, levels, **how)


def _kinds(df: DataFrame) -> DataFrame:
    """Every row of (pe_id, method) for all rows, its method and its buyer: (kind, key) in their place."""
    kind = lambda name, key: F.struct(F.lit(name).alias("kind"), key.cast("string").alias("key"))
    of = F.explode(F.array(kind("all", F.lit("all")), kind("method", F.col("method")), kind("buyer", F.col("pe_id"))))
    return df.withColumn("__of", of).select("__of.*", *(c for c in df.columns if c not in ("pe_id", "method"))).where("key <> ''")


def _first_methods(rows: DataFrame) -> DataFrame:
    """(pe_id, method): that of a buyer's first row by (signed_on, tender_id). Days are counted first, so only rows of first days are compared."""
    days = rows.groupBy("pe_id", "signed_on").agg(F.count(F.lit(1)).alias("__c")).groupBy("pe_id").agg(F.min(F.struct("signed_on")).alias("__day"))
    first = sent(days.select(F.col("pe_id").alias("__pe"), F.col("__day.signed_on").alias("__on")), "first_days")
    of_first = rows.join(first, (F.col("pe_id") == F.col("__pe")) & F.col("signed_on").eqNullSafe(F.col("__on")))
    return of_first.groupBy("pe_id").agg(F.min_by("method", F.struct("tender_id", "method")).alias("method"))


def security_fit(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (pe_id, method, lakh, security_lakh): the overall median log multiple, each method's, each buyer's shrunk to its method's.

    A buyer's method is that of its first row by (signed_on, tender_id). ``rows`` are read several times, so they are best a stored table.
    """
    ok = rows.where(plausible(F.col("lakh"), F.col("security_lakh"))).withColumn("r", F.log(F.col("lakh") / F.col("security_lakh")))
    medians = saved(ranks.quantiles(ok, ["kind", "key"], "r", {"median": F.lit(0.5)}, keys=["pe_id", "method"], spread=_kinds, stored=True), "medians")
    overall = medians.agg(F.max(F.when(F.col("kind") == "all", F.col("median"))).alias("overall")).crossJoin(F.broadcast(ok.agg(F.count(F.lit(1)).alias("n"), F.max("lakh").alias("max_lakh"))))  # one row
    by_method = medians.where((F.col("kind") == "method") & (F.col("n") >= METHOD_ROWS)).select(F.col("key").alias("method"), F.col("median").alias("by_method"))
    own = medians.where("kind = 'buyer'").select(F.col("key").alias("pe_id"), F.col("median").alias("own"), F.col("n").alias("k")).join(_first_methods(ok.where("pe_id <> ''")), "pe_id")
    shrunk = own.join(by_method, "method", "left").crossJoin(F.broadcast(overall.select("overall")))  # one row
    fallback = F.coalesce("by_method", "overall")
    by_entity = shrunk.select("pe_id", ((F.col("own") * F.col("k") + fallback * SHRINK) / (F.col("k") + SHRINK)).alias("by_entity"))
    return overall, by_method, by_entity


def security_multiple(rows: DataFrame, fit: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with ``multiple``: the buyer's own, else its method's, else the overall log multiple."""
    overall, by_method, by_entity = fit
    joined = rows.join(by_entity, "pe_id", "left").join(by_method, "method", "left").crossJoin(F.broadcast(overall.select("overall")))  # one row
    return joined.withColumn("multiple", F.coalesce("by_entity", "by_method", "overall")).drop("by_entity", "by_method", "overall")


#: An award that a security implies is believed up to so many times the greatest award ever seen.
IMPLIED_CEILING = 5.0
#: Rows a week needs to be scored, rows a fit needs, and earlier weeks whose misses make a week's band.
WEEK_ROWS, FIT_ROWS, BAND_WEEKS = 20, 50, 4


def attached_security(awards: DataFrame, details: DataFrame) -> DataFrame:
    """``awards`` with ``security_bdt``: its own, else that of the last detail page of its tender (by fetch time, then greatest)."""
    last = details.groupBy("tender_id").agg(F.max_by("security_bdt", F.struct("fetched_at", "security_bdt")).alias("__detail"))
    own = F.col("security_bdt").cast("double") if "security_bdt" in awards.columns else F.lit(None).cast("double")
    return awards.withColumn("security_bdt", own).join(last, "tender_id", "left").withColumn("security_bdt", F.coalesce("security_bdt", F.col("__detail").cast("double"))).drop("__detail")


def believed(multiple: Column, security_lakh: Column, max_lakh: Column) -> Column:
    """The award that a security implies; null, so that the row falls to history, without a security or past any award ever seen."""
    implied = F.when(security_lakh > 0, F.exp(multiple) * security_lakh)
    return F.when((F.coalesce(max_lakh, F.lit(0.0)) <= 0) | (implied <= IMPLIED_CEILING * max_lakh), implied)


def weekly_misses(rows: DataFrame, weeks: int = 30) -> DataFrame:
    """(week, place, method, pe_id, lakh, multiple, miss): rows of the last ``weeks`` weeks, priced by a fit on all rows before their week.

    ``rows``: (tender_id, signed_on, pe_id, method, lakh, security_lakh), believable ones. ``multiple`` is the buyer's shrunk median log
    multiple, else its method's, else the overall one. Weeks begin on Mondays; thin ones and those with too little before them are left
    out, and ``place`` numbers the others. Earlier rows are counted by how many of the weeks they are before, so each is read once for all.
    """
    r = F.log(F.col("lakh") / F.col("security_lakh"))
    monday = F.date_trunc("week", F.col("signed_on").cast("date")).cast("date")
    dated = saved(rows.select("tender_id", "signed_on", "pe_id", "method", "lakh", "security_lakh", monday.alias("week"), r.alias("r")), "dated")
    asked = dated.groupBy("week").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("week")).limit(weeks).where(F.col("n") >= WEEK_ROWS).select("week")
    days = [F.lit(x["week"]).cast("date") for x in asked.where("week is not null").sort("week").collect()]  # ``weeks`` at most
    slot = F.lit(0)  # the first week that is after the row's own
    for day in days:
        slot = slot + (F.col("week") >= day).cast("int")
    names = F.array(*days) if days else F.array(F.lit(None).cast("date"))

    def spread(d: DataFrame) -> DataFrame:
        by = _kinds(d)
        by = by.groupBy(*(c for c in by.columns if c != "__c")).agg(F.sum("__c").alias("__c"))
        return by.withColumn("week", F.explode(F.slice(names, F.col("slot") + 1, F.lit(len(days))))).drop("slot")

    before = dated.withColumn("slot", slot).where(F.col("slot") < len(days))
    medians = saved(ranks.quantiles(before, ["week", "kind", "key"], "r", {"median": F.lit(0.5)}, keys=["slot", "pe_id", "method"], spread=spread, stored=True), "medians")
    overall = medians.where((F.col("kind") == "all") & (F.col("n") >= FIT_ROWS)).select("week", F.col("median").alias("overall"))
    by_method = medians.where((F.col("kind") == "method") & (F.col("n") >= METHOD_ROWS)).select("week", F.col("key").alias("method"), F.col("median").alias("by_method"))
    own = medians.where("kind = 'buyer'").select("week", F.col("key").alias("pe_id"), F.col("median").alias("own"), F.col("n").alias("k"))
    # The method of a buyer's first row is the same for all later weeks.
    drawn = own.join(_first_methods(dated), "pe_id").join(by_method, ["week", "method"], "left").join(F.broadcast(overall), "week")  # a row a week
    fallback = F.coalesce("by_method", "overall")
    by_entity = drawn.select("week", "pe_id", ((F.col("own") * F.col("k") + fallback * SHRINK) / (F.col("k") + SHRINK)).alias("by_entity"))
    placed = overall.select("week", "overall", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("week")).alias("place"))  # a row a week
    priced = dated.join(F.broadcast(placed), "week").join(by_entity, ["week", "pe_id"], "left").join(by_method, ["week", "method"], "left")
    multiple = F.coalesce("by_entity", "by_method", "overall")
    return priced.select("week", "place", "method", "pe_id", "lakh", "security_lakh", multiple.alias("multiple"), (F.col("r") - multiple).alias("miss"))


def weekly_bands(misses: DataFrame) -> DataFrame:
    """(week, n, lo, hi, coverage, mape, width): each week's band is that of the misses of the BAND_WEEKS weeks before it."""
    rows = saved(misses.select("week", "place", "miss"), "misses")
    later = lambda d: d.withColumn("for", F.explode(F.sequence(F.col("place") + 1, F.col("place") + BAND_WEEKS))).drop("place")
    edges = saved(banded(rows, ["for"], "miss", keys=["place"], spread=later, stored=True).select("for", "lo", "hi"), "edges")
    scored = rows.where(F.col("place") > BAND_WEEKS)
    error = scored.select("week", F.abs(F.exp(-F.col("miss")) - 1).alias("error"))
    typical = ranks.quantiles(error, ["week"], "error", {"mape": F.lit(0.5)}, stored=True).select("week", "mape")
    held = F.col("miss").between(F.col("lo"), F.col("hi")).cast("double")
    shares = scored.join(F.broadcast(edges), F.col("place") == F.col("for")).groupBy("week", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.avg(held).alias("coverage"))  # a row a week
    return shares.join(typical, "week").select("week", "lo", "hi", "n", "coverage", "mape", F.exp(F.col("hi") - F.col("lo")).alias("width"))


def weekly_medians(rows: DataFrame, weeks: int = 26) -> DataFrame:
    """(week, n, centre, miss): each of the last weeks priced by the median log multiple of all earlier weeks.

    ``rows``: (signed_on date, r). Weeks begin on Mondays. Each earlier multiple counts once a week, so values are first counted
    to four digits: what is joined is values by weeks, not rows by weeks.
    """
    weekly = rows.withColumn("week", F.date_trunc("week", "signed_on").cast("date")).withColumn("v", F.round("r", 4))
    counts = weekly.groupBy("week", "v").agg(F.count(F.lit(1)).alias("c"))
    asked = weekly.groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("own")).orderBy(F.desc("week")).limit(weeks)
    earlier = asked.select("week", "n", "own").join(counts.select(F.col("week").alias("w0"), "v", "c"), F.col("w0") < F.col("week"))
    summed = earlier.groupBy("week", "n", "own", "v").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("week").orderBy("v")
    ranked = summed.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy("week")))
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    centre = (F.min(F.when(F.col("upto") >= lower, F.col("v"))) + F.min(F.when(F.col("upto") >= upper, F.col("v")))) / 2
    out = ranked.groupBy("week", "n", "own").agg(centre.alias("centre"))
    return out.select("week", "n", F.round("centre", 4).alias("centre"), F.round(F.col("own") - F.col("centre"), 4).alias("miss"))


def plan_pairs(estimates: DataFrame, awards: DataFrame) -> DataFrame:
    """Estimates read before the award was signed: (tender_id, method, signed_on, ratio) of positive values."""
    e = estimates.where("estimate_bdt > 0").select("tender_id", "estimate_bdt", "read_on")
    joined = awards.where("value_bdt > 0").join(e, "tender_id").where(F.col("read_on") < F.col("signed_on"))
    return joined.withColumn("ratio", F.col("value_bdt") / F.col("estimate_bdt"))


def plan_fit(pairs: DataFrame, stored: bool = False) -> DataFrame:
    """(method, n, centre, lo, hi) of log ratios; the pooled figures have a null method."""
    # Each row counts for its method and for all, so that one count of bins serves both.
    both = F.explode(F.array(F.struct("method", F.lit(False).alias("pooled")), F.struct(F.lit(None).cast("string").alias("method"), F.lit(True).alias("pooled"))))
    spread = lambda d: d.withColumn("__g", both).select("__g.*", *(c for c in d.columns if c != "method")).where("pooled or method <> ''")
    logs = pairs.select("method", F.log("ratio").alias("r"))
    return banded(logs, ["method", "pooled"], "r", keys=["method"], spread=spread, stored=stored).where((F.col("n") >= PLAN_ROWS) | F.col("pooled")).select("n", "centre", "lo", "hi", "method")


def halves(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The earlier half of stored ``rows`` by ``order`` (less one if their number is odd) and the rest.

    Rows are counted by the first column, and only those that share its value with the row in the middle are ranked, by ranges.
    """
    first, rest = order[0], order[1:]
    counts = ranks.running(rows.groupBy(first).agg(F.count(F.lit(1)).alias("__k")), [], [first], {"__b": F.col("__k")})
    half = rows.count() // 2
    middle = counts.where((F.col("__b") <= half) & (F.col("__b") + F.col("__k") > half)).first()
    if middle is None:
        return rows.where("false"), rows
    day = F.lit(middle[first]).cast(rows.schema[first].dataType)
    at = F.struct(*rest) if rest else F.struct(F.lit(0))
    mixed = ranks.ranked(rows.where(F.col(first).eqNullSafe(day)).withColumn("__at", at), [], "__at")
    early = F.col("__i") < half - middle["__b"]
    if middle[first] is None:
        before, after = rows.where("false"), rows.where(F.col(first).isNotNull())
    else:
        before, after = rows.where(F.col(first).isNull() | (F.col(first) < day)), rows.where(F.col(first) > day)
    return before.unionByName(mixed.where(early).select(*rows.columns)), after.unionByName(mixed.where(~early).select(*rows.columns))


def plan_halves(pairs: DataFrame, order: list[str]) -> DataFrame:
    """One row: fitted on the earlier half of the pairs by ``order``, scored on the later one.

    (n, n_test, test_from, median_ratio, raw_error, mape, coverage, width). Pairs are written down once; neither halves nor medians need them sorted.
    """
    rows = saved(pairs, "pairs")
    train, test = halves(rows, order)
    fit = saved(plan_fit(train, stored=True), "fit")
    own = fit.where("method is not null").select("method", "centre", "lo", "hi")
    pooled = fit.where("method is null").select(*(F.col(c).alias(f"all_{c}") for c in ("centre", "lo", "hi")))
    priced = test.join(F.broadcast(own), "method", "left").crossJoin(F.broadcast(pooled))  # a row a method, and one
    centre, lo, hi = (F.coalesce(c, f"all_{c}") for c in ("centre", "lo", "hi"))
    r = F.log("ratio")
    median = lambda df, value: ranks.quantiles(df, [], value, {value: F.lit(0.5)}, stored=True).select(value)
    scored = priced.agg(F.count(F.lit(1)).alias("n_test"), F.min("signed_on").alias("test_from"), F.avg(r.between(lo, hi).cast("double")).alias("coverage"), F.percentile(F.exp(hi - lo), 0.5).alias("width"))  # widths: one a method
    mape = median(priced.select(F.abs(F.exp(centre - r) - 1).alias("mape")), "mape")
    every = rows.agg(F.count(F.lit(1)).alias("n"))
    for figure in (median(rows.select(F.col("ratio").alias("median_ratio")), "median_ratio"), median(rows.select(F.abs(1 / F.col("ratio") - 1).alias("raw_error")), "raw_error"), scored, mape):
        every = every.crossJoin(F.broadcast(figure))  # one row each
    return every


def plan_gate(tested: int, error: float | None, coverage: float | None, rival: float | None) -> tuple[bool, str]:
    """Whether the plan route may serve, and why."""
    if tested < PLAN_TESTED:
        return False, f"{tested} of {PLAN_TESTED} awards scored so far"
    if rival is None or error is None or coverage is None:
        return False, "no security route figure to beat"
    if error >= rival:
        return False, f"median error {error:.1%} does not beat the security route's {rival:.1%}"
    if not PLAN_COVERAGE[0] <= coverage <= PLAN_COVERAGE[1]:
        return False, f"band held {coverage:.1%} of awards, outside {PLAN_COVERAGE[0]:.0%} to {PLAN_COVERAGE[1]:.0%}"
    return True, f"beats the security route ({error:.1%} against {rival:.1%}) with an honest band"


def conformal_pad(scores: DataFrame, groups: list[str], value: str = "score") -> DataFrame:
    """(groups, n, pad): the quantile of scores at ceil((n + 1) 0.8) / n."""
    n = F.col("__n")
    return ranks.quantiles(scores, groups, value, {"pad": F.least(F.lit(1.0), F.ceil((n + 1) * COVERAGE) / n)})


def expanding_prior(rows: DataFrame, keys: list[str], value: str, order: list[str], grand: float, smooth: float = 5.0) -> DataFrame:
    """``rows`` with ``prior`` (mean of the key's earlier rows, drawn to ``grand``) and ``history`` (how many they are)."""
    held = ranks.running(rows, keys, order, {"history": F.lit(1).cast("bigint"), "__sum": F.coalesce(F.col(value), F.lit(0.0))})
    return held.withColumn("prior", (F.col("__sum") + smooth * grand) / (F.col("history") + smooth)).drop("__sum")


def ordered_band(q10: Column, q50: Column, q90: Column) -> tuple[Column, Column]:
    return F.least(q10, q50), F.greatest(q90, q50)


def deferred(q10: Column, q90: Column, history: Column, category: Column, basis: Column) -> Column:
    wide = F.coalesce(F.try_divide(q90, q10) > DEFER_WIDTH, F.lit(True))
    unknown = (history < DEFER_HISTORY) & (F.coalesce(category, F.lit("")) == "")
    return (wide | unknown) & (basis != "security")


def routed(tenders: DataFrame, security: DataFrame, plan: DataFrame, history: DataFrame) -> DataFrame:
    """(tender_id, q10, q50, q90, basis): the plan's band where there is one, else the security's, else that of history.

    Each route: (tender_id, q10, q50, q90), one row a tender at most.
    """
    named = lambda df, p: df.select("tender_id", *(F.col(c).alias(f"{p}_{c}") for c in ("q10", "q50", "q90")))
    out = tenders.select("tender_id").join(named(plan, "plan"), "tender_id", "left").join(named(security, "security"), "tender_id", "left").join(named(history, "history"), "tender_id", "left")
    basis = F.when(F.col("plan_q50").isNotNull(), "plan").when(F.col("security_q50").isNotNull(), "security").otherwise("history")
    pick = lambda c: F.when(F.col("basis") == "plan", F.col(f"plan_{c}")).when(F.col("basis") == "security", F.col(f"security_{c}")).otherwise(F.col(f"history_{c}")).alias(c)
    return out.withColumn("basis", basis).select("tender_id", pick("q10"), pick("q50"), pick("q90"), "basis")
