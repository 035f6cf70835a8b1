"""Entities from names that are spelled in many ways: blocks, likeness of character runs, human decisions, components, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.functions import names as N
from ledgerfold.functions.scalars import entity_id
from ledgerfold.operators import graph
from ledgerfold.storage import saved

MERGE, REVIEW = 0.85, 0.60
#: A block of more names is divided by their second word.
MAX_BLOCK = 4000
GRAMS = (2, 3, 4)


def char_grams(word: Column) -> Column:
    """Runs of 2 to 4 characters of a word with a space on each side; a shorter padded word is a run itself, once."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    of = lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))).when(F.length(padded) == n - 1, F.array(padded) if n == min(GRAMS) else F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(n) for n in GRAMS))


def blocks(names: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(norm, block) of distinct normalised names. Names of a block of more than ``max_block`` meet within their second word only."""
    keyed = names.select("norm").where("norm <> ''").distinct().withColumn("block", N.block_key(F.col("norm")))
    sized = keyed.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("block")))
    second = F.coalesce(F.get(N.tokens(F.col("norm")), F.lit(1)), F.lit(""))
    return sized.select("norm", F.when(F.col("__n") > max_block, F.concat_ws("|", "block", second)).otherwise(F.col("block")).alias("block"))


def similar_pairs(blocked: DataFrame, floor: float = REVIEW) -> DataFrame:
    """(a, b, score), a < b: pairs of one block whose TF-IDF cosine over character runs is ``floor`` or more; IDF is of the block.

    Runs are joined as an inverted index, so pairs without a common run are never formed.
    """
    runs = blocked.select("block", "norm", F.explode(F.flatten(F.transform(N.tokens(F.col("norm")), char_grams))).alias("g"))
    tf = runs.groupBy("block", "norm", "g").agg(F.count(F.lit(1)).alias("tf"))
    size = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    df = tf.groupBy("block", "g").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(size, "block").join(df, ["block", "g"]).withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    unit = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("block", "norm")))).where("df > 1").select("block", "g", "norm", "w")
    a, b = unit.select("block", "g", F.col("norm").alias("a"), F.col("w").alias("wa")), unit.select("block", "g", F.col("norm").alias("b"), F.col("w").alias("wb"))
    met = a.join(b, ["block", "g"]).where("a < b")
    return met.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")).where(F.col("score") >= floor)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b)."""
    placed = graph.components(edges.select("a", "b"))
    return nodes.select(node).join(placed.withColumnRenamed("node", "at"), F.col(node) == F.col("at"), "left").select(node, F.coalesce("component", node).alias("component"))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, decision) of the pairs a person has settled, each once, a < b."""
    rows = spark.read.csv(path, header=True).where(F.col("decision").isin("merge", "keep"))
    a, b = pair_key(F.col("a"), F.col("b"))
    return rows.select(a.alias("a"), b.alias("b"), "decision").dropDuplicates(["a", "b"])


def split_pairs(pairs: DataFrame, decided: DataFrame, merge: float = MERGE) -> DataFrame:
    """``pairs`` with ``verdict``: a decision where there is one, else merge by score, else review."""
    verdict = F.coalesce("decision", F.when(F.col("score") >= merge, F.lit("merge")).otherwise(F.lit("review")))
    return pairs.join(decided.select("a", "b", "decision"), ["a", "b"], "left").withColumn("verdict", verdict).drop("decision")


def write_review(pairs: DataFrame, decided: DataFrame, path: str) -> None:
    """The queue as CSV: decided pairs first, then those to review from the likest down."""
    open_pairs = pairs.where("verdict = 'review'").select("a", "b", F.format_string("%.4f", "score").alias("score"), F.lit("").alias("decision"))
    every = decided.select("a", "b", F.lit("").alias("score"), "decision").unionByName(open_pairs)
    every.orderBy(F.col("decision") == "", F.desc("score"), "a", "b").coalesce(1).write.mode("overwrite").csv(path, header=True)


def resolve(counts: DataFrame, decided: DataFrame | None = None, merge: float = MERGE, review: float = REVIEW, max_block: int = MAX_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (name, n_rows): names with ``entity_id``, entities (entity_id, canonical_name, variants, n_rows), pairs with verdicts.

    Spellings that normalise alike are one; the id is of the commonest spelling (the least of equals); a blank name has an empty id.
    ``decided``: (a, b, decision) of normalised names.
    """
    spark = counts.sparkSession
    decided = decided if decided is not None else spark.createDataFrame([], "a string, b string, decision string")
    normed = counts.select("name", "n_rows", N.normalize_name(F.col("name")).alias("norm"))
    normed = saved(normed, "names")
    pairs = saved(split_pairs(similar_pairs(blocks(normed, max_block), review), decided, merge), "pairs")
    merged = decided.where("decision = 'merge'").select("a", "b").unionByName(pairs.where("verdict = 'merge'").select("a", "b")).distinct()
    parts = components(normed.select(F.col("norm").alias("node")).where("node <> ''").distinct(), merged)
    placed = normed.join(parts, normed["norm"] == parts["node"], "left")
    best = placed.where("component is not null").groupBy("component").agg(F.min_by(F.struct("name", "norm"), F.struct(-F.col("n_rows"), "name")).alias("c"), F.sum("n_rows").alias("n_rows"), F.sort_array(F.collect_list(F.struct((-F.col("n_rows")).alias("k"), "name"))).alias("v"))
    entities = best.select("component", entity_id(F.col("c.norm")).alias("entity_id"), F.col("c.name").alias("canonical_name"), F.col("v.name").alias("variants"), "n_rows")
    named = placed.join(entities.select("component", "entity_id"), "component", "left").select("name", "n_rows", F.coalesce("entity_id", F.lit("")).alias("entity_id"))
    return named, entities.drop("component"), pairs
