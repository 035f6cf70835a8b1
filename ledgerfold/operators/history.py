"""The history route: a median from past awards, and a band around it that is calibrated on later ones."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.functions.scalars import title_numerics
from ledgerfold.operators import bands
from ledgerfold.storage import freed, saved

CATEGORIES = ["method", "category", "ministry"]
NUMBERS = ["month", "year_offset", "title_len", "title_words", "n_numbers", "max_number", "sum_number", "has_unit", "has_year_range", "text_score", "history", "prior"]
YEAR, TRAIN_SHARE, TEXT_FOLDS = 2020, 0.8, 4
#: Shares of the fitting period at which walk-forward calibration cuts, and the widening steps of the band.
EDGES, STEP, MOST = (0.4, 0.55, 0.7, 0.85, 1.0), 0.05, 3.0


def features(rows: DataFrame, day: str = "signed_on") -> DataFrame:
    """``rows`` with figures of the title and the date; no date is June of the base year."""
    when = F.col(day).try_cast("date")
    out = rows.withColumns({k: c.cast("double") for k, c in title_numerics(F.col("title")).items()})
    return out.withColumn("month", F.coalesce(F.month(when), F.lit(6)).cast("double")).withColumn("year_offset", (F.coalesce(F.year(when), F.lit(YEAR)) - YEAR).cast("double"))


def cut_date(rows: DataFrame, share: float = TRAIN_SHARE, day: str = "signed_on") -> str:
    """The date of the row at ``share`` of all rows by date; rows of one day stay on one side.

    Rows are counted by day, so the running sum is over days.
    """
    days = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    upto = days.withColumn("upto", F.sum("n").over(every.orderBy(day))).withColumn("all", F.sum("n").over(every))
    return upto.where(F.col("upto") >= F.col("all") * share).agg(F.min(day)).first()[0]


def text_model(features_: int = 1 << 14) -> Pipeline:
    """A ridge on words of the title."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="title", outputCol="__w", pattern=r"\W+"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=features_), IDF(inputCol="__tf", outputCol="__x", minDocFreq=2),
        LinearRegression(featuresCol="__x", labelCol="y", predictionCol="text_score", regParam=0.1, elasticNetParam=0.0, solver="l-bfgs", maxIter=40),
    ])


def stacked(rows: DataFrame, key: str = "tender_id") -> tuple[DataFrame, PipelineModel]:
    """``rows`` with ``text_score`` from models that have not seen the row, and the model of all rows for new ones."""
    dealt = rows.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(TEXT_FOLDS)))
    out = None
    for k in range(TEXT_FOLDS):
        seen, rest = dealt.where(F.col("__fold") != k), dealt.where(F.col("__fold") == k)
        got = text_model().fit(seen).transform(rest).select(*rows.columns, "text_score")
        out = got if out is None else out.unionByName(got)
    return out, text_model().fit(rows)


def model(label: str = "y", trees: int = 60) -> Pipeline:
    """Boosted trees on absolute loss; a category that is blank or was not seen is a value of its own."""
    index = StringIndexer(inputCols=CATEGORIES, outputCols=[f"__{c}" for c in CATEGORIES], handleInvalid="keep", stringOrderType="frequencyDesc")
    assemble = VectorAssembler(inputCols=[*(f"__{c}" for c in CATEGORIES), *NUMBERS], outputCol="__f", handleInvalid="keep")
    return Pipeline(stages=[index, assemble, GBTRegressor(featuresCol="__f", labelCol=label, predictionCol=f"{label}_hat", lossType="absolute", maxIter=trees, maxDepth=5, maxBins=256, stepSize=0.1, seed=0)])


def walk_forward(rows: DataFrame, day: str = "signed_on", edges: tuple[float, ...] = EDGES, trees: int = 30) -> DataFrame:
    """Rows of each later slice with a median from all before it: what a band is calibrated on."""
    cuts = [cut_date(rows, e, day) for e in edges]
    out = None
    for low, high in zip(cuts, cuts[1:], strict=False):
        before, now = rows.where(F.col(day) <= low), rows.where((F.col(day) > low) & (F.col(day) <= high))
        got = model(trees=trees).fit(before).transform(now).select(*rows.columns, "y_hat")
        out = got if out is None else out.unionByName(got)
    return out


def scaled_band(calibration: DataFrame, group: str = "method", least: int = 300) -> DataFrame:
    """(group, lo, hi): quantiles of the miss over its predicted size, by group; a null group is that of all, for thin ones.

    ``calibration``: (group, miss, size).
    """
    rows = calibration.withColumn("r", F.try_divide("miss", F.greatest("size", F.lit(1e-6))))
    own = bands.banded(rows, [group], "r").where(F.col("n") >= least)
    return own.unionByName(bands.banded(rows, [], "r").withColumn(group, F.lit(None).cast("string"))).select(group, "n", "lo", "hi")


def drift(rows: DataFrame, target: float = bands.COVERAGE) -> float:
    """The least widening (1 to 3 by steps) under which later rows (r, lo, hi) are inside as often as promised."""
    steps = [1 + STEP * i for i in range(round((MOST - 1) / STEP) + 1)]
    inside = [F.avg(F.col("r").between(F.col("lo") * k, F.col("hi") * k).cast("double")).alias(f"k{i}") for i, k in enumerate(steps)]
    found = rows.agg(*inside).first()
    return next((k for i, k in enumerate(steps) if (found[i] or 0.0) >= target), MOST)


def cqr_pad(calibration: DataFrame, group: str = "method", least: int = 300) -> DataFrame:
    """(group, pad) for a pair of quantile predictions: what both edges need so that the promised share is inside; null: all.

    ``calibration``: (group, y, lo, hi).
    """
    scored = calibration.withColumn("score", F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")))
    own = bands.conformal_pad(scored, [group]).where(F.col("n") >= least)
    return own.unionByName(bands.conformal_pad(scored.withColumn(group, F.lit(None).cast("string")), [group])).select(group, "n", "pad")


#: Steps by which a pad grows until a later block is covered, and how far it may.
PAD_STEP, PAD_MOST = 0.02, 2.0


def drifted_pads(calibration: DataFrame, later: DataFrame, group: str = "method", least: int = 300) -> DataFrame:
    """``cqr_pad``, each pad widened by steps until the promised share of its own rows in a later block is inside; null: all.

    Both sides: (group, y, lo, hi). A group with fewer than ``least`` later rows keeps its pad. The step that a row needs is counted, so the
    search is a running sum over PAD_MOST / PAD_STEP counts a group.
    """
    pads = cqr_pad(calibration, group, least)
    scored = later.select(group, F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")).alias("score"))
    both = scored.unionByName(scored.withColumn(group, F.lit(None).cast("string")))
    known = pads.select(F.col(group).alias("__g"), "pad")
    needs = F.greatest(F.lit(0), F.ceil((F.col("score") - F.col("pad")) / PAD_STEP - 1e-9)).cast("int")
    counts = both.join(F.broadcast(known), F.col(group).eqNullSafe(F.col("__g"))).withColumn("step", needs).groupBy("__g", "step").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("__g")
    reached = counts.withColumn("share", F.sum("n").over(w.orderBy("step")) / F.sum("n").over(w)).withColumn("all", F.sum("n").over(w))
    most = round(PAD_MOST / PAD_STEP)
    found = reached.where(F.col("share") >= bands.COVERAGE).groupBy("__g").agg(F.min("step").alias("step"), F.max("all").alias("all"))
    extra = F.when(F.col("all") >= least, F.least(F.coalesce("step", F.lit(most)), F.lit(most)) * PAD_STEP).otherwise(0.0)
    return pads.join(found, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, "n", (F.col("pad") + F.coalesce(extra, F.lit(0.0))).alias("pad"))


def banded_prediction(rows: DataFrame, edges: DataFrame, size: Column, group: str = "method", widening: float = 1.0) -> DataFrame:
    """``rows`` (y_hat in logs) with q10, q50, q90: the group's edges, or those of all, times the predicted size of the miss."""
    own = edges.where(F.col(group).isNotNull()).select(group, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    pooled = edges.where(F.col(group).isNull()).select(F.col("lo").alias("__plo"), F.col("hi").alias("__phi"))
    joined = rows.join(own, group, "left").crossJoin(F.broadcast(pooled))  # one row
    lo, hi = F.coalesce("__lo", "__plo") * widening, F.coalesce("__hi", "__phi") * widening
    q50 = F.exp("y_hat")
    q10, q90 = bands.ordered_band(F.exp(F.col("y_hat") + lo * size), q50, F.exp(F.col("y_hat") + hi * size))
    return joined.withColumns({"q10": q10, "q50": q50, "q90": q90}).drop("__lo", "__hi", "__plo", "__phi")


def trained(rows: DataFrame, trees: int = 60) -> tuple[PipelineModel, PipelineModel, DataFrame]:
    """Median model, model of the miss's size, and calibrated edges, from (y, features): the last fifth by date calibrates."""
    rows = saved(rows, "features")
    cut = cut_date(rows)
    early, late = rows.where(F.col("signed_on") <= cut), rows.where(F.col("signed_on") > cut)
    median = model(trees=trees).fit(early)
    missed = saved(median.transform(early).select(*rows.columns, F.abs(F.col("y") - F.col("y_hat")).alias("miss_size")), "missed")
    difficulty = model("miss_size", trees).fit(missed)
    scored = difficulty.transform(median.transform(late).select(*rows.columns, "y_hat").withColumn("miss_size", F.lit(0.0)))
    edges = saved(scaled_band(scored.select("method", (F.col("y") - F.col("y_hat")).alias("miss"), F.col("miss_size_hat").alias("size"))), "edges")
    freed(rows, missed)
    return median, difficulty, edges
