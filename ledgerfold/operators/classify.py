"""The text classifier: fit, folds, prior of the buyer, confidence bar below which it does not answer."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.operators import evaluate
from ledgerfold.storage import freed, saved

TARGET, FALLBACK = 0.93, 0.60
LEAST_OF_CLASS, FOLDS, DROPOUT, PRIOR_WEIGHT = 5, 5, 0.3, 1.0
FORMAT = 1


def trainable(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows of classes that have enough of them."""
    enough = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= LEAST_OF_CLASS).drop("__n")
    return rows.join(enough, label, "left_semi")


def with_dropout(brief: Column, key: Column, share: float = DROPOUT, seed: int = 0) -> Column:
    """An empty brief for a share of rows by hash, so that the model learns to do without."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < int(share * 1000), F.lit("")).otherwise(brief)


#: Runs of 3 to 5 characters within a word that has a space on each side, as an expression over the words ``__w``.
_RUNS = "flatten(transform(__w, w -> flatten(transform(sequence(3, 5), n -> if(length(w) + 2 < n, array(), transform(sequence(1, length(w) + 3 - n), i -> substring(' ' || w || ' ', i, n)))))))"


def features(label: str = "label", text: str = "text", buckets: int = 1 << 16) -> list:
    """Words, pairs of words and hashed runs of characters, each counted once a text, by inverse document frequency."""
    return [
        StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"\W+"),
        NGram(n=2, inputCol="__w", outputCol="__w2"),
        CountVectorizer(inputCol="__w", outputCol="__c1", minDF=2, vocabSize=80_000, binary=True),
        HashingTF(inputCol="__w2", outputCol="__c2", numFeatures=buckets, binary=True),
        SQLTransformer(statement=f"SELECT *, {_RUNS} AS __ch FROM __THIS__"),
        HashingTF(inputCol="__ch", outputCol="__c3", numFeatures=buckets, binary=True),
        VectorAssembler(inputCols=["__c1", "__c2", "__c3"], outputCol="__c"),
        IDF(inputCol="__c", outputCol="__x"),
    ]


def fitted(rows: DataFrame, label: str = "label", text: str = "text", cost: float = 4.0, buckets: int = 1 << 16, most: int = 60) -> PipelineModel:
    """Logistic regression on ``features``; the vectors are written once, and its iterations read these."""
    rows = saved(rows.select(label, text), "texts")
    made = Pipeline(stages=features(label, text, buckets)).fit(rows)
    vectors = saved(made.transform(rows).select("__y", "__x"), "vectors")
    regression = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1 / (cost * max(1, vectors.count())), standardization=False, maxIter=most, probabilityCol="__p", predictionCol="__k")
    model = PipelineModel(stages=[*made.stages, regression.fit(vectors)])
    freed(rows, vectors)
    return model


def fold_of(label: str, key: str, folds: int = FOLDS, repeat: int = 0) -> Column:
    """Stratified folds: rows of a class in order of a hash, dealt round."""
    return F.pmod(F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(repeat)), key)), F.lit(folds))


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``guess``, ``conf`` and ``proba`` (array by class in order of names)."""
    labels = model.stages[0].labels
    scored = model.transform(rows)
    p = vector_to_array("__p")
    named = scored.withColumn("proba", p).withColumn("conf", F.array_max("proba")).withColumn("guess", F.element_at(F.lit(labels), F.col("__k").cast("int") + 1))
    return named.select(*rows.columns, "guess", "conf", "proba")


def out_of_fold(rows: DataFrame, key: str = "tender_id", label: str = "label", folds: int = FOLDS, repeats: int = 3, buckets: int = 1 << 16) -> DataFrame:
    """Every row once a repeat, predicted by a model that has not seen it."""
    out = None
    for repeat in range(repeats):
        dealt = saved(rows.withColumn("__fold", fold_of(label, key, folds, repeat)), "folds")
        for k in range(folds):
            model = fitted(dealt.where(F.col("__fold") != k), label, buckets=buckets)
            got = predicted(model, dealt.where(F.col("__fold") == k).drop("__fold")).withColumn("repeat", F.lit(repeat))
            out = got if out is None else out.unionByName(got)
    return out


def tallies(rows: DataFrame, classes: list[str], entity: str = "pe_id", label: str = "label") -> DataFrame:
    """(entity, tally): how often an entity had each class, in order."""
    per = rows.where(F.coalesce(entity, F.lit("")) != "").groupBy(entity).pivot(label, classes).count().fillna(0)
    return per.select(entity, F.array(*(F.col(f"`{c}`").cast("double") for c in classes)).alias("tally"))


def blended(proba: Column, tally: Column, weight: float = PRIOR_WEIGHT) -> Column:
    """Probabilities times what the entity usually buys, made to sum to one; as they were without a history."""
    total = F.aggregate(tally, F.lit(0.0), lambda a, x: a + x)
    raw = F.zip_with(proba, tally, lambda p, t: p * F.pow((t + 1) / (total + F.size(tally)), F.lit(weight)))
    whole = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.when(tally.isNull() | (whole <= 0), proba).otherwise(F.transform(raw, lambda x: x / whole))


def bar(curve: DataFrame, target: float = TARGET) -> float:
    """The lowest confidence that keeps the target accuracy, or the fallback."""
    found = evaluate.deferral_for(curve, (target,)).first()
    return float(found["threshold"]) if found and found["threshold"] is not None else FALLBACK


def answered(guess: Column, conf: Column, at: float) -> tuple[Column, Column]:
    return F.when(conf >= at, guess).otherwise(F.lit("")), F.round(conf, 4)


def save(model: PipelineModel, path: str, facts: dict) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(facts | {"format": FORMAT}),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict] | None:
    """A saved model with its facts; None if it has another format."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    return (PipelineModel.load(f"{path}/model"), facts) if facts.get("format") == FORMAT else None
