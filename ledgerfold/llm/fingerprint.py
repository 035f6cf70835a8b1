"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every five-word shingle is hashed once. The upper bits of a hash name its bin, a bin keeps its least
hash, and an empty bin takes the value of a bin that has one: the first such bin in an order of all bins
that belongs to the empty bin alone (optimal densification). The lowest bits of each bin are stored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.native import let, white_words

BINS, BITS, SHINGLE_WORDS = 256, 4, 5
VALUE_BITS = 55
VALUE = (1 << VALUE_BITS) - 1
LANE = 64 // BITS
#: Bins an empty bin asks one after another, before all that have a value are compared.
PROBES = 8
#: Rows that one block of the order should hold, and how many blocks there may be: cut points times equal parts of each.
BLOCK_ROWS, CUTS, PARTS = 2_000, 1_024, 64

_draw = random.Random(256)
#: The order of bins that empty bin i asks: (shift + j * stride) mod BINS for j = 0, 1, ...; an odd stride meets each bin once.
_STRIDES = [2 * _draw.randrange(BINS // 2) + 1 for _ in range(BINS)]
_SHIFTS = [_draw.randrange(BINS) for _ in range(BINS)]
_BACK = [pow(stride, -1, BINS) for stride in _STRIDES]


def _bin(h: Column) -> Column:
    return F.shiftright(h, VALUE_BITS)


def _shingles(words: Column) -> Column:
    """63-bit hashes of the text's shingles; a text of fewer words, but not none, has its whole sequence as one."""

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE_WORDS), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(SHINGLE_WORDS))), 1))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(h), 1))
        return F.when(F.size(h) >= SHINGLE_WORDS, each).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _fill(bins: Column, full: Column, strides: Column, shifts: Column, back: Column) -> Column:
    """Values of all bins; ``bins``: value or null, ``full``: bin and value of those that have one. The rest: the tables of the orders."""
    last = F.lit(BINS - 1)

    def nearest(i: Column) -> Column:
        place = lambda v, away, turn: F.shiftleft(((_bin(v) - away) * turn).bitwiseAND(last.cast("bigint")), VALUE_BITS).bitwiseOR(v.bitwiseAND(F.lit(VALUE)))
        return F.array_min(F.transform(full, lambda v: place(v, F.get(shifts, i), F.get(back, i)))).bitwiseAND(F.lit(VALUE))

    asked = lambda i, j: F.get(bins, (F.get(shifts, i) + F.get(strides, i) * j).bitwiseAND(last))
    # A value taken over is hashed with its new bin, else the copies of one unequal value would agree or differ in their low bits all together.
    taken = lambda i: F.xxhash64(F.coalesce(*(asked(i, j) for j in range(PROBES)), nearest(i)), i)
    return F.transform(bins, lambda v, i: F.coalesce(v, taken(i)))


def _pack(values: Column) -> Column:
    """The lowest bits of each bin, in BINS / LANE longs."""

    def lane(at: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for j in range(LANE):
            out = out.bitwiseOR(F.shiftleft(F.get(values, at * LANE + j).bitwiseAND(F.lit(2**BITS - 1).cast("bigint")), BITS * j))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // LANE - 1)), lane)


def fingerprint(text: Column) -> Column:
    """array<bigint> of the packed bins; all zero for a text without words (null, empty, blank)."""
    ends = F.lit([(i << VALUE_BITS) | VALUE for i in range(BINS)])

    def binned(hashes: Column) -> Column:
        least = let(F.sort_array(F.concat(hashes, ends)), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))
        empty = lambda v: v.bitwiseAND(F.lit(VALUE)) == VALUE
        return let(least, lambda m: let(F.transform(m, lambda v: F.when(~empty(v), v.bitwiseAND(F.lit(VALUE)))), lambda bins: let(F.filter(m, lambda v: ~empty(v)), lambda full: filled(bins, full))))

    def filled(bins: Column, full: Column) -> Column:
        # The tables are bound once for each text: an array of literals is made anew wherever it stands.
        return let(F.lit(_STRIDES), lambda a: let(F.lit(_SHIFTS), lambda c: let(F.lit(_BACK), lambda back: let(_fill(bins, full, a, c, back), _pack))))

    zero = F.lit([0] * (BINS // LANE)).cast("array<bigint>")
    return let(_shingles(white_words(F.lower(text))), lambda s: F.when(F.size(s) > 0, binned(s)).otherwise(zero))


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, 0 to 1, corrected for low bits that agree by chance."""
    low = F.lit(sum(1 << BITS * j for j in range(LANE)))

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(low))

    unlike = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (1 - unlike / F.lit(float(BINS)) - chance) / (1 - chance))


def _number(value: Column, kind: str, skip: int = 0) -> Column:
    """A number that is never less for a greater value: for text, of the six bytes after the first ``skip``."""
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), F.lit(skip + 1), F.lit(6))), 12, "0"), 16, 10).cast("double")
    return (value.cast("timestamp") if kind in ("date", "timestamp_ntz") else value.cast("int") if kind == "boolean" else value).cast("double")


def _common(first: str | bytes | None, last: str | bytes | None) -> int:
    """Bytes that the least and the greatest of some texts, and so all, begin with."""
    first, last = (x.encode() if isinstance(x, str) else bytes(x or b"") for x in (first or "", last or ""))
    return next((i for i, (x, y) in enumerate(zip(first, last, strict=False)) if x != y), min(len(first), len(last)))


def with_next(docs: DataFrame, order: str, tie: str, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of each carried column: from the following row by descending ``order``, after the last from the first.

    Rows are dealt to blocks of neighbouring ``order`` values (cut points from one aggregate over that column, each stretch between them
    in equal parts) and each block also gets the first row of the block after it, so that no order over all rows is needed.
    Equal values of ``order`` follow by ``tie``, a text; null values come last. Where nulls or one number hold many rows, blocks divide
    these by ``tie`` in the same way. ``order``: numbers, times or texts; texts are dealt by the six bytes after what all begin with.
    """
    kind = docs.schema[order].dataType.simpleString()
    textual = kind in ("string", "binary")
    n, held, low, high = docs.agg(F.count(F.lit(1)), F.count(order), *((F.min(order), F.max(order)) if textual else (F.lit(None), F.lit(None)))).first()
    cuts = min(CUTS, max(1, n // BLOCK_ROWS))
    parts = min(PARTS, max(1, n // (BLOCK_ROWS * cuts)))
    value = _number(F.col(order), kind, _common(low, high))
    steps, exact = [i / cuts for i in range(cuts + 1)], max(10_000, 10 * cuts)
    given = docs.agg(F.percentile_approx(value, steps, exact).alias("p")).first()["p"] or [0.0]
    points = sorted(set(given), reverse=True)  # the greatest first
    # Values that fill a stretch alone; only numbers that are whole as doubles are told apart by them.
    heavy = [x for x in points if given.count(x) > 2] if not textual else []
    spans = max(1, len(points) - 1)
    tops, bottoms = [*points[:-1], points[0]][:spans], [*points[1:], points[-1]][:spans]
    span = F.least(F.size(F.filter(F.lit(points[1:] or points), lambda c: c > value)), F.lit(spans - 1))
    top, bottom = (F.get(F.lit([float(x) for x in side]), span) for side in (tops, bottoms))
    part = F.floor((top - value) / (top - bottom + 1) * parts)
    block = F.when(value.isNull(), F.lit(spans * parts)).otherwise(span * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))).cast("bigint")
    crowded = value.isin(heavy) & (value.cast(kind) == F.col(order)) if heavy else F.lit(False)
    many, seconds, beside = F.coalesce(F.col(order).isNull() | crowded, F.lit(False)), [], F.lit(0.0)
    if heavy or held < n:
        crowd = docs.where(many)
        first, last = crowd.agg(F.min(tie), F.max(tie)).first()
        beside = _number(F.col(tie), "string", _common(first, last))
        seconds = sorted(set(crowd.agg(F.percentile_approx(beside, steps, exact).alias("p")).first()["p"] or []))
    # Within a block: what is above a heavy value, its own rows by tie, what is below it.
    level = 2 * F.coalesce(F.size(F.filter(F.lit(heavy or [float("-inf")]), lambda c: c > value)), F.lit(0)) + many.cast("int")
    finer = F.when(many, F.size(F.filter(F.lit(seconds or [0.0]), lambda c: c < beside))).otherwise(0)
    width = len(seconds) + 2
    dealt = docs.withColumn("__block", block * ((2 * len(heavy) + 2) * width) + level * width + finer)
    # One row for each block: at most CUTS * PARTS + 1 blocks, and CUTS more for each heavy value and for null.
    line = Window.partitionBy("__one").orderBy("__block")
    head_tie = F.min(F.when(many, F.col(tie))) if seconds else F.lit(None).cast("string")
    heads = dealt.groupBy("__block").agg(F.max(order).alias("__head"), F.xxhash64(head_tie).alias("__head_tie"), F.lit(1).alias("__one"))
    before = F.coalesce(F.lag("__block").over(line), F.max("__block").over(Window.partitionBy("__one")))
    heads = heads.select(F.col("__block").alias("__of"), "__head", "__head_tie", before.alias("__before"))
    here, there = F.struct(F.col("__block").alias("block"), F.lit(0).alias("guest")), F.struct(F.col("__before").alias("block"), F.lit(1).alias("guest"))
    leads = F.col(order).eqNullSafe(F.col("__head")) & (~many | (F.xxhash64(tie) == F.col("__head_tie")))
    placed = dealt.join(F.broadcast(heads), F.col("__block") == F.col("__of")).withColumn("__at", F.explode(F.when(leads, F.array(here, there)).otherwise(F.array(here))))
    w = Window.partitionBy("__at.block").orderBy("__at.guest", F.col(order).desc_nulls_last(), F.col(tie).asc_nulls_first())
    following = placed.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return following.where("__at.guest = 0").select(*docs.columns, *(f"next_{c}" for c in carried))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the text with its last third (in code points, rounded down) replaced by as many of the first of the next
    document by descending id. Null texts count as empty; texts without words have a fingerprint of zeros and are alike.
    Equal texts have equal fingerprints. Ids: numbers, times or texts. A repeated id follows in order of its texts; null ids come last. A table of one row is its own next.
    Other columns of ``docs`` are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    beside = with_next(base.withColumn("mark", fingerprint(F.col("text"))), "id", "text", ["text", "mark"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = beside.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut)))
    marked = edited.select("id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "mark", "next_mark", fingerprint(F.col("edited")).alias("edited_mark"))
    return marked.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("mark")).alias("fingerprint"), as_hex(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
