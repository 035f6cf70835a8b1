"""A corpus from raw documents to a mix for training, in five stages over the columns of ``documents``.

Each stage reads what the one before it wrote. All but the last return the columns they were given, whatever their names. All stages
take null, empty and very long texts, null and repeated ids, repeated rows and empty tables; each states what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm import decontam, linedup, mixing, neardup, quality
from ledgerfold.llm.store import freed, saved, unused

#: Documents below this probability of being good are rejected.
QUALITY_BAR = 0.3


def _met(docs: DataFrame, marks: DataFrame, how: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` joined with ``marks`` (doc_id, text_hash) by id and text; columns ``carried`` keep the names they have in ``marks``."""
    own, of, of_hash = (unused(docs.columns, c) for c in ("text_hash", "id_of", "hash_of"))
    keyed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    on = marks.select(F.col("doc_id").alias(of), F.col("text_hash").alias(of_hash), *carried)
    return keyed.join(on, (F.col(own) == F.col(of_hash)) & F.col("doc_id").eqNullSafe(F.col(of)), how)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier does not reject; it is fitted to those of them that have labels.

    A row's text alone decides, so equal texts, null and repeated ids and repeated rows are judged alike; null and empty texts have the
    score of a text without words.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs.columns, "score")
    return quality.scored(docs, model, score_col=score).where(F.col(score) >= QUALITY_BAR).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows of lines; documents of which nothing is left go. ``n_chars`` follows the text.

    Of equal passages that of the least id stays (null first). Rows of one id and text are treated alike; null and empty texts stay.
    """
    n_lines, n_removed = (unused(docs.columns, c) for c in ("n_lines", "n_removed"))
    cut = linedup.without_repeats(docs, n_lines=n_lines, n_removed=n_removed)
    lost = F.col(n_removed) > 0
    kept = cut.where(~lost | (F.col("text") != ""))
    return kept.withColumn("n_chars", F.when(lost, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the least id, and one row of it.

    A null or repeated id may be of several groups: the least hash of text of each stays. Texts without words are in no group: one row
    stays of each id and text.
    """
    marked = neardup.near_duplicates(docs, keyed=True)
    rows = marked.where("kept").groupBy("doc_id", "group", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    alone = F.when(F.col("group").isNull(), F.col("text_hash"))
    top = rows.groupBy("doc_id", "group", alone.alias("alone")).agg(F.min(F.struct("text_hash", "n")).alias("top"))
    times = unused(docs.columns, "times")
    ids = saved(top.select("doc_id", "top.text_hash", F.col("top.n").alias(times)), "kept")
    single = _met(docs, ids.where(F.col(times) == 1), "inner", (times,)).select(*docs.columns)
    if ids.where(F.col(times) > 1).isEmpty():
        return single
    own = unused(docs.columns, "text_hash")
    again = _met(docs, ids.where(F.col(times) > 1), "inner", (times,)).dropDuplicates(["doc_id", own])
    return single.unionByName(again.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Rows of one text are judged alike; null and empty texts stay."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keyed=True)
    bad = saved(found.where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    return _met(docs, bad, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the columns of ``documents`` and ``copy``, from 1; those taken 0 times go.

    Rows of one id, source and size are exchangeable: what the mix takes of them is dealt to them in order. Texts without words go.
    ``copy`` gets underscores where ``docs`` have a column of that name.
    """
    taken = mixing.mixture(docs).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.collect_list(F.when(F.col("copies") != 0, F.col("copies"))).alias("each"))
    dealt = saved(taken.where("most > 0").withColumn("each", F.when(F.col("least") < F.col("most"), F.sort_array("each", asc=False))), "taken")
    least, each, copy, size = (unused(docs.columns, c) for c in ("least", "each", "copy", "size"))
    on = dealt.select(F.col("doc_id").alias("of"), F.col("source").alias("from"), F.col("size").alias("of_size"), F.col("least").alias(least), F.col("each").alias(each))
    names = {c: unused([*docs.columns, least, each, copy, size], c) for c in ("of", "from", "of_size")}
    on = on.withColumnsRenamed(names)
    same = F.col("doc_id").eqNullSafe(F.col(names["of"])) & F.col("source").eqNullSafe(F.col(names["from"])) & (F.col(size) == F.col(names["of_size"]))
    met = docs.withColumn(size, mixing.words_in(F.col("text"))).join(on, same)
    copies = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(copy)
    alike = met.where(F.col(each).isNull()).select(*docs.columns, copies(F.col(least)))
    if dealt.where("each is not null").isEmpty():
        return alike
    n = F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text")))
    own = met.where(F.col(each).isNotNull()).withColumn(least, F.get(F.col(each), n - 1))
    return alike.unionByName(own.where(F.col(least).isNotNull()).select(*docs.columns, copies(F.col(least))))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, what came before it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if i:
            freed(before)
    return docs


#: A trained classifier and a random draw are not SQL; tests hold run() against a version without Spark.
ORACLE_SQL: str | None = None
