"""Mixing of sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source should be copied as often as the source's target asks for, which is a whole number and a fraction.
The fractions are rounded in pairs: mass, weighed by size, moves at random from one to the other until one is 0 or 1, and
the other goes on to the next pair. Blocks of documents leave one fraction each; blocks of such rests leave one each again,
up a tree, until a source has one left. So a source's words miss its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.native import let, white_words
from ledgerfold.llm.store import saved

#: Fractions that meet in one block of the tree.
FAN_IN = 64
#: Rows that are equal in all columns which one step numbers.
ALIKE = 4_096
#: Weights of the sources by code point of their names, repeating; share of all words to take; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): ``share`` of all sizes by weight, none above ``most`` times its source.

    Sources that reach their bound first are those with the least bound for their weight: in that order, all up to some place stop at
    the bound and the others share what is left. One row for each source; their order needs one task, for millions of sources at most.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()))
    weighed = per.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bounded = weighed.withColumn("bound", most * F.col("source_size"))
    wanted = (
        bounded.withColumn("all", share * F.sum("source_size").over(everything))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    level = F.col("left") / F.col("weight_left")
    # The first that stays below its bound sets the level for itself and all after it.
    found = wanted.withColumn("free", level * F.col("weight") <= F.col("bound")).withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("bound") / F.col("weight"), "source", level.alias("level")))).over(everything)["level"])
    return found.select("source", "source_size", F.least(F.col("bound"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))).alias("target"))


def _item(held: Column, size: Column, p: Column) -> Column:
    return F.struct(held.alias("held"), size.cast("double").alias("size"), p.cast("double").alias("p"))


def _fold(items: Column, salt: Column, held_type: str) -> Column:
    """Rounds an array of (held, size, p) from left to right: struct of ``out`` (held, x: 0 or 1) and ``rest``, the last fraction or null."""
    item_type = f"struct<held:{held_type},size:double,p:double>"
    none = F.lit(None).cast(item_type)
    start = F.struct(F.array().cast(f"array<struct<held:{held_type},x:int>>").alias("out"), none.alias("rest"), F.lit(0).alias("n"))
    settled = lambda it: (it["p"] <= 1e-12) | (it["p"] >= 1 - 1e-12)
    done = lambda it: F.struct(it["held"].alias("held"), F.when(it["p"] > 0.5, 1).otherwise(0).alias("x"))

    def pair(a: Column, b: Column, n: Column) -> Column:
        """Both after the transfer; the expectation of each p stays, and so does p * size of the pair."""
        up, down = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]), F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        draw = F.pmod(F.xxhash64(salt, n, a["size"], b["size"]), F.lit(1 << 40)) / float(1 << 40)
        moved = F.when(draw * (up + down) < down, up).otherwise(-down)
        return F.array(_item(a["held"], a["size"], a["p"] + moved / a["size"]), _item(b["held"], b["size"], b["p"] - moved / b["size"]))

    def step(s: Column, it: Column) -> Column:
        n = s["n"] + 1
        put = lambda out, rest: F.struct(out.alias("out"), rest.alias("rest"), n.alias("n"))
        alone = F.when(settled(it), put(F.concat(s["out"], F.array(done(it))), s["rest"])).otherwise(put(s["out"], it))

        def after(ab: Column) -> Column:
            over, rest = F.filter(ab, settled), F.filter(ab, lambda x: ~settled(x))
            return put(F.concat(s["out"], F.transform(over, done)), F.get(rest, F.lit(0)))

        return F.when(s["rest"].isNull() | settled(it), F.when(s["rest"].isNull(), alone).otherwise(put(F.concat(s["out"], F.array(done(it))), s["rest"]))).otherwise(let(pair(s["rest"], it, n), after))

    return F.aggregate(items, start, step)


def rounded(items: DataFrame, seed: int = 5) -> DataFrame:
    """``items`` (source, id, size > 0, p) with ``x``, 0 or 1 at random with expectation ``p``, the sum of size * x of a source within one size of that of size * p.

    Same rows, same result, however they are dealt. Rows may repeat and ids may be null: rows that are equal in all columns are counted,
    and numbered from there, so that they lie in different blocks. Blocks of about FAN_IN rows meet at each level of the tree.
    """
    held_type = f"struct<id:{items.schema['id'].dataType.simpleString()},size:bigint>"
    counted = items.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    most = counted.agg(F.max("rows")).first()[0] or 0
    # As many rows as there are sources: with the rows, so that each row knows how many blocks its source has.
    alike = items.groupBy("source", "id", "size", "p").agg(F.count(F.lit(1)).alias("alike"))
    # Two steps, so that no task numbers more than ALIKE equal rows alone.
    runs = alike.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("alike") - 1) / ALIKE))).alias("run")).repartition("source", "id", "size", "run")
    numbered = runs.select("source", "id", "size", "p", F.explode(F.sequence(F.col("run") * ALIKE, F.least(F.col("alike"), (F.col("run") + 1) * ALIKE) - 1)).alias("number"))
    blocked = numbered.join(counted, numbered["source"].eqNullSafe(counted["source"])).drop(counted["source"])
    hashed = F.xxhash64("id", "size", "number", F.lit(seed))
    level = blocked.select("source", F.pmod(hashed, F.ceil(F.col("rows") / FAN_IN)).alias("block"), hashed.alias("place"), _item(F.struct("id", F.col("size").cast("bigint").alias("size")), F.col("size"), F.col("p")).alias("item"))
    outs, depth = [], 0
    while True:
        gathered = level.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("items"))
        folded = gathered.select("source", "block", _fold(F.col("items.item"), F.xxhash64("source", "block", F.lit(seed), F.lit(depth)), held_type).alias("f"))
        kept = saved(folded.select("source", "block", "f.out", "f.rest"), "rounding")
        outs.append(kept.select("source", F.explode("out").alias("o")))
        if most <= FAN_IN:
            # One fraction of a source is left: a last draw.
            last = F.pmod(F.xxhash64("source", F.lit(seed), F.lit("last")), F.lit(1 << 40)) / float(1 << 40) < F.col("rest.p")
            outs.append(kept.where("rest is not null").select("source", F.struct(F.col("rest.held").alias("held"), F.when(last, 1).otherwise(0).alias("x")).alias("o")))
            break
        most = -(-most // FAN_IN)
        level = kept.where("rest is not null").select("source", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("block").alias("place"), F.col("rest").alias("item"))
        depth += 1
    every = outs[0]
    for out in outs[1:]:
        every = every.unionByName(out)
    return every.select("source", "o.held.id", "o.held.size", "o.x")


def words_in(text: Column) -> Column:
    return F.size(white_words(text.cast("string"))).cast("bigint")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 5) -> DataFrame:
    """One row for each row of ``docs``: id, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size``: words between ASCII white space (null text: 0). ``copies``: how often the mix takes the row, ``taken``: copies times size;
    no more than ``most`` times, rounded up. Null is a source of its own, the last. Rows of size 0 are taken 0 times. Repeated rows are
    rounded each by itself. An empty table gives an empty mix. Other columns of ``docs`` are not read.
    """
    sized = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "sizes")
    goal = saved(targets(sized, weights, share, most), "targets")
    rate = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).select(F.col("source").alias("of"), "source_size", "target", F.floor(F.col("rate") + 1e-12).alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + 1e-12)).alias("p"))
    parts = rounded(sized.where("size > 0").join(rate, sized["source"].eqNullSafe(rate["of"])).select("source", "id", "size", "p"), seed)
    every = parts.unionByName(sized.where("size = 0").select("source", "id", "size", F.lit(0).alias("x")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("x")).otherwise(0).cast("bigint")
    return every.join(rate, every["source"].eqNullSafe(rate["of"])).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size").cast("bigint").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
