"""How well bands and classifiers do: coverage, error, strata, curves of accuracy and cost, run-to-run noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.operators import ranks

#: Rows a stratum or a bucket needs to be reported.
STRATUM_ROWS, BUCKET_ROWS = 30, 50


def inside() -> Column:
    return F.col("value").between(F.col("q10"), F.col("q90"))


def coverage_by(rows: DataFrame, groups: list[str], least: int = 0) -> DataFrame:
    """(groups, n, coverage, mape, width) of (value, q10, q50, q90)."""
    out = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(inside().cast("double")), 4).alias("coverage"), F.round(F.percentile(F.abs(F.col("q50") - F.col("value")) / F.col("value"), 0.5), 4).alias("mape"), F.round(F.percentile(F.col("q90") / F.col("q10"), 0.5), 3).alias("width")
    )
    return out.where(F.col("n") >= least)


def weighted_coverage(rows: DataFrame, weight: str) -> DataFrame:
    """One row: share of weight inside the band, over positive finite weights."""
    w = F.col(weight)
    ok = rows.where((w > 0) & (w < float("inf")))
    return ok.agg(F.round(F.sum(F.when(inside(), w).otherwise(0.0)) / F.sum(w), 4).alias("coverage_weighted"), F.count(F.lit(1)).alias("n"))


def strata(rows: DataFrame, by: str = "q50", parts: int = 5) -> DataFrame:
    """Figures of parts of equal frequency by ``by``: edges are exact percentiles, a value on an edge belongs above it."""
    edges = rows.agg(F.percentile(by, [i / parts for i in range(1, parts)]).alias("edges"))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("stratum", F.size(F.filter("edges", lambda e: e <= F.col(by))))  # one row
    return coverage_by(placed, ["stratum"], STRATUM_ROWS)


def staleness(rows: DataFrame, days: str) -> DataFrame:
    """Figures by age in days: under 7, to 21, to 45, and beyond."""
    d = F.col(days)
    bucket = F.when(d < 7, "under 7").when(d < 21, "7 to 21").when(d < 45, "21 to 45").otherwise("over 45")
    return coverage_by(rows.withColumn("age", bucket), ["age"], BUCKET_ROWS)


def curve_by_confidence(rows: DataFrame) -> DataFrame:
    """(conf, kept, right, total): running counts from the most confident down, by distinct confidence."""
    counts = rows.groupBy("conf").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("correct").cast("long")).alias("r"))
    total = counts.agg(F.sum("k").alias("total"))
    held = ranks.running(counts.withColumn("down", -F.col("conf")), [], ["down"], {"kept": F.col("k"), "right": F.col("r")})
    return held.crossJoin(F.broadcast(total)).select("conf", (F.col("kept") + F.col("k")).alias("kept"), (F.col("right") + F.col("r")).alias("right"), "total")  # one row


def deferral_for(curve: DataFrame, targets: tuple[float, ...] = (0.93, 0.95, 0.97)) -> DataFrame:
    """(target, threshold, deferral): the least deferral that reaches each accuracy; null where none does."""
    asked = F.explode(F.array(*(F.lit(t) for t in targets))).alias("target")
    ok = curve.select("*", asked).where(F.col("right") / F.col("kept") >= F.col("target"))
    found = ok.groupBy("target").agg(F.max("kept").alias("kept"), F.min("conf").alias("threshold"), F.max("total").alias("total"))
    every = curve.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    return every.join(found, "target", "left").select("target", "threshold", F.round(1 - F.col("kept") / F.col("total"), 4).alias("deferral"))


def cost_points(curve: DataFrame, ratios: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """(wrong_answer_costs, deferral, accuracy): where a wrong answer costs so many times as much as none."""
    asked = curve.select("*", F.explode(F.array(*(F.lit(r) for r in ratios))).alias("wrong_answer_costs"))
    cost = F.col("wrong_answer_costs") * (F.col("kept") - F.col("right")) + F.col("total") - F.col("kept")
    best = asked.groupBy("wrong_answer_costs").agg(F.min_by(F.struct("kept", "right", "total"), F.struct(cost, "kept")).alias("b"))
    return best.select("wrong_answer_costs", F.round(1 - F.col("b.kept") / F.col("b.total"), 4).alias("deferral"), F.round(F.col("b.right") / F.col("b.kept"), 4).alias("accuracy"))


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: the plain mean of each true or guessed class's F1."""
    counted = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = counted.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).alias("said")), F.struct(F.col("g").alias("c"), F.lit(0).alias("hit"), F.lit(0).alias("true"), F.col("n").alias("said")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("true").alias("true"), F.sum("said").alias("said"))
    return per.agg(F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("true") + F.col("said")), F.lit(0.0))), 4).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


#: Buckets that the rows of a bootstrap are counted in: a bucket's draws are Poisson with its count as mean.
BOOT_BUCKETS = 64


def bootstrap_coverage(rows: DataFrame, resamples: int = 400, seed: int = 0) -> DataFrame:
    """(lo, hi): 2.5 and 97.5 percent of the coverage over Poisson resamples.

    A sum of Poisson draws is Poisson of the summed mean, so rows are counted first, by hit and by bucket of a hash, and each resample
    draws for these few counts. A draw is a normal one for counts from 100, else by inversion.
    """
    hit = inside().cast("int")
    counts = rows.groupBy(hit.alias("hit"), F.pmod(F.xxhash64(*rows.columns), F.lit(BOOT_BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    drawn = counts.where("hit is not null").select("hit", "bucket", "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    uniform = lambda k: (F.pmod(F.xxhash64("hit", "bucket", "b", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
    # Inversion: how many partial sums of the distribution lie below the draw, up to 250 of a mean below 100.
    start = F.struct(F.exp(-F.col("n")).alias("term"), F.exp(-F.col("n")).alias("sum"), F.lit(0).alias("k"))
    step = lambda s, i: F.struct((s["term"] * F.col("n") / i).alias("term"), (s["sum"] + s["term"] * F.col("n") / i).alias("sum"), (s["k"] + (uniform(1) >= s["sum"]).cast("int")).alias("k"))
    small = F.aggregate(F.sequence(F.lit(1), F.lit(250)), start, step)["k"].cast("double")
    weight = F.when(F.col("n") < 100, small).otherwise(F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * normal)))
    per = drawn.withColumn("w", weight).groupBy("b").agg(F.try_divide(F.sum(F.col("hit") * F.col("w")), F.sum("w")).alias("c"))
    return per.agg(F.percentile("c", 0.025).alias("lo"), F.percentile("c", 0.975).alias("hi"))


def run_noise(runs: DataFrame, order: str = "run") -> DataFrame:
    """(figure, runs, first, last, min, max, spread, typical_step, largest_step, net_change) of (run, figure, value), from three runs up.

    The typical step is the upper median.
    """
    w = Window.partitionBy("figure").orderBy(order)
    stepped = runs.where("value is not null").withColumn("step", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("place", F.row_number().over(Window.partitionBy("figure").orderBy(F.col("step").asc_nulls_last())))
    n = F.count(F.lit(1)).over(Window.partitionBy("figure"))
    middle = stepped.withColumn("n", n).withColumn("typical", F.when(F.col("place") == F.floor((F.col("n") - 1) / 2) + 1, F.col("step")))
    r = lambda c, name: F.round(c, 4).alias(name)
    first, last = F.min_by("value", order), F.max_by("value", order)
    out = middle.groupBy("figure").agg(F.count(F.lit(1)).alias("runs"), r(first, "first"), r(last, "last"), r(F.min("value"), "min"), r(F.max("value"), "max"), r(F.max("value") - F.min("value"), "spread"), r(F.max("typical"), "typical_step"), r(F.max("step"), "largest_step"), r(last - first, "net_change"))
    return out.where("runs >= 3")


def live_mix(live: DataFrame) -> DataFrame:
    """(method, n, share, without): each method's share of the live rows that publish no security, and how many that is."""
    without = F.coalesce(F.col("security_bdt"), F.lit(0.0)) <= 0
    per = live.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(without).alias("without"))
    total = F.sum("without").over(Window.partitionBy(F.lit(1)))
    return per.select("method", "n", "without", F.round(F.col("without") / total, 4).alias("share"))


def security_share(live: DataFrame) -> DataFrame:
    """One row: live rows, and the share of them that publish a security."""
    return live.agg(F.count(F.lit(1)).alias("live"), F.round(F.avg((F.coalesce(F.col("security_bdt"), F.lit(0.0)) > 0).cast("double")), 4).alias("share"))


def projected(figures: DataFrame, mix: DataFrame) -> DataFrame:
    """(coverage, mape, width) expected on the live mix: figures of each method weighed by its share; methods without figures count not."""
    joined = mix.join(figures, "method")
    weighed = lambda c: F.round(F.sum(F.col(c) * F.col("share")) / F.sum("share"), 4).alias(c)
    return joined.agg(weighed("coverage"), weighed("mape"), weighed("width"))


def held_out_bar(rows: DataFrame, key: str, target: float) -> DataFrame:
    """(half, bar, accuracy, deferral): the bar from one half of the keys, the figures from the other, both ways round.

    Halves are of keys, not of predictions; a half on which no bar reaches the target has none.
    """
    halved = rows.withColumn("half", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(2)).cast("int"))
    counts = halved.groupBy("half", "conf").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("correct").cast("long")).alias("r"))
    w = Window.partitionBy("half").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("kept", F.sum("k").over(w)).withColumn("right", F.sum("r").over(w))
    bars = running.where(F.col("right") / F.col("kept") >= target).groupBy("half").agg(F.min("conf").alias("bar"))
    other = halved.withColumn("half", 1 - F.col("half")).join(F.broadcast(bars), "half")  # two rows
    acted = F.col("conf") >= F.col("bar")
    return other.groupBy("half", "bar").agg(F.round(F.avg(F.when(acted, F.col("correct").cast("double"))), 4).alias("accuracy"), F.round(1 - F.avg(acted.cast("double")), 4).alias("deferral"))


def category_sources(tenders: DataFrame) -> DataFrame:
    """One row: live tenders, and the shares of them whose category the portal and the model gave; shares are null without any."""
    share = lambda source: F.round(F.avg((F.coalesce("category_source", F.lit("")) == source).cast("double")), 4)
    return tenders.where("status = 'Live'").agg(F.count(F.lit(1)).alias("live"), share("portal").alias("portal_share"), share("model").alias("model_share"))


def task_progress(tasks: DataFrame) -> DataFrame:
    """One row: weight done and in all, and its share."""
    done = F.sum(F.when(F.col("done"), F.col("weight")).otherwise(0))
    return tasks.agg(done.alias("done"), F.sum("weight").alias("total"), F.round(done / F.sum("weight"), 4).alias("share"))
