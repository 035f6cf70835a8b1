"""Labels from a hierarchy of codes and from keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A division of at least so many groups, of which so large a share is ticked, was ticked whole.
EXPAND_GROUPS, EXPAND_SHARE = 5, 0.6
#: A mapped value that says nothing.
SILENT = "silent"


def longest_prefix(codes: DataFrame, prefixes: DataFrame, code: str = "code", shortest: int = 2) -> DataFrame:
    """``codes`` with ``prefix`` and ``category`` of the longest prefix that is mapped; null where none is.

    Each distinct code meets its own prefixes: an equi-join on a few rows for each code.
    """
    each = codes.select(code).distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.length(code))), lambda n: F.left(F.col(code), n))))
    best = each.join(prefixes.select("prefix", "category"), "prefix").groupBy(code).agg(F.max_by(F.struct("prefix", "category"), F.length("prefix")).alias("b"))
    return codes.join(best, code, "left").withColumn("category", F.col("b.category")).withColumn("prefix", F.col("b.prefix")).drop("b")


def code_names(rows: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """(label, code): each code under its label and under the first part of one with semicolons, folded."""
    names = F.array_distinct(F.array(F.col(label), F.get(F.split(label, ";"), F.lit(0))))
    return rows.select(F.explode(names).alias("label"), code).select(F.lower(F.btrim("label")).alias("label"), code).distinct()


def code_list(rows: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """(label, code): one code for each name of ``code_names``, the least."""
    return code_names(rows, code, label).groupBy("label").agg(F.min(code).alias(code))


def tag_codes(tags: DataFrame, codes: DataFrame, wordings: dict[str, str], old_picks: dict[str, list[str]], key: str = "tender_id") -> DataFrame:
    """(key, code) of portal tags (key, tag): by the official list (label, code), then by older wordings.

    Where a key has a tag that begins like one of ``old_picks``, codes with its prefixes are left out.
    """
    spark = tags.sparkSession
    folded = tags.where("tag is not null").select(key, folded_tag(F.col("tag")).alias("label")).distinct()
    official = code_list(codes.withColumn("label", folded_tag(F.col("label"))))
    older = spark.createDataFrame([(k, v) for k, v in wordings.items()], "label string, old string")
    found = folded.join(official, "label", "left").join(older, "label", "left").select(key, F.coalesce("code", "old").alias("code")).where("code is not null")
    picks = spark.createDataFrame([(root, p) for root, ps in old_picks.items() for p in ps], "root string, prefix string")
    silenced = folded.join(F.broadcast(picks), F.col("label").startswith(F.col("root"))).select(F.col(key).alias("__k"), "prefix").distinct()
    return found.join(silenced, (F.col(key) == F.col("__k")) & F.col("code").startswith(F.col("prefix")), "left_anti")


def folded_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(F.regexp_replace(tag, r"\s+", " "))), r"\.+$", "")


def winners(votes: DataFrame, key: str, choice: str = "choice", n: str = "n") -> DataFrame:
    """(key, choice, margin): the choice with most votes, unless another has as many or it has less than half."""
    w = Window.partitionBy(key)
    placed = votes.withColumn("__all", F.sum(n).over(w)).withColumn("__place", F.row_number().over(w.orderBy(F.desc(n), choice))).withColumn("__next", F.lead(n, 1, 0).over(w.orderBy(F.desc(n), choice)))
    return placed.where((F.col("__place") == 1) & (F.col(n) > F.col("__next")) & (F.col(n) / F.col("__all") >= 0.5)).select(key, choice, (F.col(n) - F.col("__next")).alias("margin"))


def code_vote(tags: DataFrame, prefixes: DataFrame, divisions: DataFrame, sectors: DataFrame, key: str = "tender_id", twins: tuple[str, str] = ("50", "51"), typed: tuple[str, ...] = ("construction",)) -> DataFrame:
    """(key, sector, category, margin, codes) of each key's codes.

    ``tags``: (key, code). ``divisions``: (division, groups, sector): how many groups of four digits it has, and its sector or null.
    ``prefixes``: (prefix, category); ``sectors``: (category, sector) of fine categories. A division that is ticked whole votes for its
    sector once for each code; the two twin divisions count as ticked whole together. Silent codes do not vote. A sector in ``typed`` has
    categories of its own, which are left open where one of its divisions was ticked whole; other sectors are their own category.
    """
    codes = tags.where("code is not null and code <> ''").select(key, "code").distinct().withColumn("division", F.left("code", F.lit(2)))
    ticked = codes.groupBy(key, "division").agg(F.countDistinct(F.left("code", F.lit(4))).alias("ticked"))
    whole = ticked.join(divisions, "division", "left").withColumn("whole", F.coalesce((F.col("groups") >= EXPAND_GROUPS) & (F.col("ticked") / F.col("groups") >= EXPAND_SHARE), F.lit(False)))
    twin = F.max(F.when(F.col("division").isin(*twins), F.col("whole").cast("int"))).over(Window.partitionBy(key))
    whole = whole.withColumn("whole", F.col("whole") | (F.col("division").isin(*twins) & (F.coalesce(twin, F.lit(0)) == 1))).select(key, "division", "whole", F.col("sector").alias("of_division"))
    looked = longest_prefix(codes, prefixes).join(whole, [key, "division"]).join(sectors.select("category", F.col("sector").alias("of_category")), "category", "left")
    voting = looked.where(F.col("whole") | (F.coalesce("category", F.lit("")) != SILENT))
    sector = F.when(F.col("whole"), F.col("of_division")).otherwise(F.coalesce("of_category", "of_division"))
    by_sector = voting.withColumn("choice", sector).where("choice is not null").groupBy(key, "choice").agg(F.count(F.lit(1)).alias("n"))
    by_category = voting.where(~F.col("whole") & F.col("category").isNotNull()).groupBy(key, F.col("category").alias("choice"), F.col("of_category")).agg(F.count(F.lit(1)).alias("n"))
    top = winners(by_sector, key).withColumnRenamed("choice", "sector")
    fine = winners(by_category.join(top.select(key, F.col("sector").alias("of_category")), [key, "of_category"]).select(key, "choice", "n"), key).select(key, F.col("choice").alias("category"))
    blurred = whole.where("whole").select(key, F.col("of_division").alias("sector")).distinct().withColumn("blurred", F.lit(True))
    counted = codes.groupBy(key).agg(F.count(F.lit(1)).alias("codes"))
    out = counted.join(top, key, "left").join(fine, key, "left").join(blurred, [key, "sector"], "left")
    return out.select(key, "sector", F.when(~F.col("sector").isin(*typed), F.col("sector")).when(F.col("blurred").isNull(), F.col("category")).alias("category"), F.coalesce("margin", F.lit(0)).alias("margin"), "codes")


def keyword_label(text: Column, keywords: dict[str, list[str]]) -> tuple[Column, Column]:
    """(category, margin) of a text: the category with most of its keywords in the text, null where another has as many or none has any."""
    text = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array(*(F.struct(sum((text.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(c).alias("c")) for c, words in keywords.items()))
    ranked = F.sort_array(hits, asc=False)
    first, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1))["n"], F.lit(0))
    return F.when((first["n"] > 0) & (first["n"] > second), first["c"]), F.when(first["n"] > 0, first["n"] - second).otherwise(0)


def by_source(tenders: DataFrame, tagged: DataFrame, predicted: DataFrame, bar: float) -> DataFrame:
    """``tenders`` with category, category_confidence and category_source: from tags, else from the model above its bar, else none."""
    out = tenders.join(tagged.select("tender_id", F.col("category").alias("__tag")), "tender_id", "left").join(predicted.select("tender_id", F.col("category").alias("__guess"), "conf"), "tender_id", "left")
    tag, sure = F.coalesce("__tag", F.lit("")) != "", F.coalesce(F.col("conf") >= bar, F.lit(False))
    return out.select(
        *tenders.columns, F.when(tag, F.col("__tag")).when(sure, F.col("__guess")).otherwise("").alias("category"), F.when(tag, F.lit(1.0)).otherwise(F.round("conf", 4)).alias("category_confidence"),
        F.when(tag, "portal").when(sure, "model").otherwise("").alias("category_source"),
    )


def hierarchy_match(category: Column, asked: Column, children: dict[str, list[str]] | None = None) -> Column:
    """Whether a category is the one asked for or a child of it."""
    out = category == asked
    for parent, kids in (children or {}).items():
        out = out | ((asked == parent) & category.isin(*kids))
    return out


def shown_label(slug: Column, labels: dict[str, str]) -> Column:
    """A slug's label; an unknown slug with spaces for underscores."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, slug), F.replace(slug, F.lit("_"), F.lit(" ")))
