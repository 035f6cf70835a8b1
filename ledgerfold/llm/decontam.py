"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Windows of an item's words are the sets, their word shingles the elements. Shingles are ordered by how often the whole corpus holds
them. A window that a document contains has all its shingles there, so its rarest one alone (the prefix for exact containment) must
be in the document: only that one is joined. The shingle's place in the window fixes where the window would begin, which must
leave room for all of it, and the words there are then compared one by one.

Shingles meet without their document's words: one pass over the corpus finds where shingles of windows stand, from which they are
counted too, and a second one compares the words of each document with its candidates, all in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.native import ascii_lower, let
from ledgerfold.llm.store import freed, saved

WINDOW_WORDS, SHINGLE_WORDS = 10, 3
#: Shingles of windows (one number each, some 40 bytes in a hash table) that are sent to every executor at most; with more, the join deals out both sides.
BROADCAST_SHINGLES = 1_000_000

#: Between words: ASCII other than letters and digits.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all else that is not ASCII, A-Z in lower case; none for null."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS)
    # A text that begins or ends between words leaves an empty string there only.
    ends = lambda w: F.slice(w, F.when(F.element_at(w, 1) == "", 2).otherwise(1), F.greatest(F.lit(0), F.size(w) - F.when(F.element_at(w, 1) == "", 1).otherwise(0) - F.when((F.element_at(w, -1) == "") & (F.size(w) > 1), 1).otherwise(0)))
    return let(split, ends)


def _grams(words: Column, n: int) -> Column:
    """Hashes of every run of ``n`` words, in order; none where there are fewer."""
    each = lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), each)


def windows(items: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(window, words) of all distinct windows, and (window, item_id) of every item."""
    w = F.col("words")
    each = F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.slice(w, i, width))).when(F.size(w) > 0, F.array(w)).otherwise(F.array().cast("array<array<string>>"))
    parted = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), item_words(F.col(text_col).cast("string")).alias("words"))
    of = saved(parted.select("item_id", F.explode(each).alias("words")).select("item_id", "words", F.md5(F.concat_ws(" ", "words").cast("binary")).alias("window")), "windows")
    return of.groupBy("window").agg(F.min("words").alias("words")), of.select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW_WORDS, keyed: bool = False, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A window is ``width`` consecutive words of an item, or all its words where it has fewer; an item without words (null, empty) has
    none. A document's word inside any occurrence of any window is hit. ``n_items``: ids with an occurring window; ``items_sha256``: of
    these ids as strings, sorted, comma-joined (null id: empty string; equal ids are one item). Null and empty texts have no words and no
    hits. Repeated rows are judged alike, once each. ``keyed``: with ``text_hash``, the xxhash64 of the row's text. Other columns are not
    read. ``broadcast_shingles`` decides how the corpus meets the shingles, not what is found.
    """
    whole, of_item = windows(items, item_col, item_text_col, width)
    whole = saved(whole.withColumn("grams", F.least(F.size("words"), F.lit(SHINGLE_WORDS))), "windows")
    lengths = sorted(r[0] for r in whole.select("grams").distinct().collect())
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    key = ["id", "text_hash"]

    gram_of = whole.select("window", "words", "grams", F.posexplode(F.element_at(F.array(*(F.when(F.col("grams") == n, _grams(F.col("words"), n)) for n in range(1, SHINGLE_WORDS + 1))), F.col("grams"))).alias("offset", "gram"))
    gram_of = saved(gram_of, "grams")
    asked = saved(gram_of.select("gram").distinct(), "asked")
    near = (lambda df: F.broadcast(df)) if asked.count() <= broadcast_shingles else (lambda df: df)

    # Where the corpus holds shingles of windows. Rows of one id and text say the same, so one of each place is enough.
    placed = [F.transform(_grams(F.col("words"), n), lambda g, i: F.struct(g.alias("gram"), i.alias("at"))) for n in lengths]
    worded = base.select(*key, item_words(F.col("text")).alias("words"))
    every = worded.select(*key, F.explode(F.concat(F.array().cast("array<struct<gram:bigint,at:int>>"), *placed)).alias("g")).select(*key, "g.gram", "g.at")
    stand = saved(every.join(near(asked), "gram"), "places")

    counts = stand.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rarity = gram_of.join(counts, "gram", "left").withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("held", F.lit(0)), "gram", "offset")))
    prefix = saved(rarity.where("rank = 1 and held is not null").select("gram", "offset", "window", F.col("words").alias("wanted")), "prefixes")
    candidates = stand.join(prefix, "gram").withColumn("begin", F.col("at") - F.col("offset")).where("begin >= 0")
    by_text = saved(candidates.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("begin", "window", "wanted"))).alias("asked")), "candidates")
    freed(stand, gram_of, asked)

    # Each document with its candidates: those whose words are there, and the words that they cover, from left to right.
    a, b = base.alias("a"), by_text.alias("b")
    met = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left").select("a.id", "a.text_hash", "a.text", "b.asked")
    none = F.array().cast(by_text.schema["asked"].dataType)
    real = lambda w: F.filter(F.coalesce("asked", none), lambda c: (c["begin"] + F.size(c["wanted"]) <= F.size(w)) & (F.slice(w, c["begin"] + 1, F.size(c["wanted"])) == c["wanted"]))
    judged = met.select(*key, let(item_words(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), real(w).alias("hits"))).alias("r"))
    end = lambda c: c["begin"] + F.size(c["wanted"])
    step = lambda s, c: F.struct((s["n"] + F.greatest(F.lit(0), end(c) - F.greatest(c["begin"], s["to"]))).alias("n"), F.greatest(s["to"], end(c)).alias("to"))
    n_hit = F.aggregate("r.hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("bigint")
    hits = saved(judged.select(*key, "r.n_words", n_hit.alias("n_hit"), F.array_distinct(F.transform("r.hits", lambda c: c["window"])).alias("windows")), "hits")

    named = hits.where("n_hit > 0").select(*key, F.explode("windows").alias("window")).distinct().join(of_item, "window").select(*key, "item_id").distinct()
    listed = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))
    listed = saved(listed, "listed")
    freed(by_text, prefix)
    m, n = hits.select(*key, "n_words", "n_hit").alias("m"), listed.alias("n")
    return m.join(n, F.col("m.id").eqNullSafe(F.col("n.id")) & (F.col("m.text_hash") == F.col("n.text_hash")), "left").select(
        F.col("m.id").alias(id_col), *([F.col("m.text_hash").alias("text_hash")] if keyed else []), "m.n_words", "m.n_hit", F.coalesce("n.n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("n.ids", F.lit("")), 256).alias("items_sha256"), (F.col("m.n_hit") > 0).alias("contaminated"),
    )
