"""Scalar functions over columns: dates, numbers, slugs, title figures, ids and texts for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAKA_PER_CRORE, TAKA_PER_LAKH = 10_000_000.0, 100_000.0
#: Values above this many crore were keyed in taka.
UNIT_LIMIT = 500.0
#: Words that count as a unit in a title; fixed values.
UNITS = ["km", "kilometer", "metre", "meter", "mtr", "no", "nos", "pc", "pcs", "piece", "set", "sets", "ton", "mt", "litre", "liter", "ltr", "kg", "unit", "packet", "bag", "sqm", "sft", "cft", "rft"]
#: Quantities read from one title at most.
NUMBERS_READ = 12


def parse_datetime(text: Column) -> Column:
    """The first ``13-Sep-2026 11:00`` of a text as ``2026-09-13T11:00``; null if there is none or it is no date."""
    found = F.regexp_extract(text, r"(\d{2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2})", 1)
    return F.date_format(F.try_to_timestamp(found, F.lit("dd-MMM-yyyy HH:mm")), "yyyy-MM-dd'T'HH:mm")


def parse_day(text: Column) -> Column:
    """The first ``13-Sep-2026`` of a text as ``2026-09-13``."""
    found = F.regexp_extract(text, r"(\d{2}-[A-Za-z]{3}-\d{4})", 1)
    return F.date_format(F.try_to_timestamp(found, F.lit("dd-MMM-yyyy")), "yyyy-MM-dd")


def parse_number(text: Column) -> Column:
    """Digits and dots of a text as a number; null without digits or with several dots."""
    kept = F.regexp_replace(text, r"[^\d.]", "")
    return F.when(F.length(kept) - F.length(F.replace(kept, F.lit("."))) <= 1, kept.try_cast("double"))


def parse_int(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d]", "").try_cast("bigint")


def repaired_value(value: Column) -> Column:
    """Crore; what was keyed in taka divided."""
    return F.when(value > UNIT_LIMIT, value / TAKA_PER_CRORE).otherwise(value)


def slug(text: Column) -> Column:
    """Lower case, other than a-z and 0-9 as underscores, ``none`` for nothing."""
    made = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(made == "", F.lit("none")).otherwise(made)


def compose(title: Column, entity: Column, ministry: Column, brief: Column, nature: Column | None = None, method: Column | None = None) -> Column:
    """The text a classifier reads."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat_ws(" || ", *(empty(c) for c in (title, entity, ministry, brief)))
    if nature is None and method is None:
        return text
    return F.concat(text, F.lit(" || nature_"), slug(nature if nature is not None else F.lit("")), F.lit(" method_"), slug(method if method is not None else F.lit("")))


def title_numerics(title: Column) -> dict[str, Column]:
    """Quantity signals of a title, by name."""
    title = F.coalesce(title, F.lit(""))
    each = F.transform(F.slice(F.regexp_extract_all(title, F.lit(r"(\d[\d,]*\.?\d*)"), 1), 1, NUMBERS_READ), lambda x: F.replace(x, F.lit(",")).try_cast("double"))
    numbers = F.when(F.size(each) > 0, each).otherwise(F.array(F.lit(0.0)))
    return {
        "title_len": F.length(title),
        "title_words": F.size(F.filter(F.split(title, r"\s+"), lambda w: w != "")),
        "n_numbers": F.size(numbers),
        "max_number": F.log1p(F.array_max(numbers)),
        "sum_number": F.log1p(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)),
        "has_unit": title.rlike(rf"(?i)\b({'|'.join(UNITS)})\b").cast("int"),
        "has_year_range": title.rlike(r"20\d\d\s*-\s*20\d\d").cast("int"),
    }


def entity_id(name: Column, salt: str = "") -> Column:
    """The first 12 hex digits of the SHA-1 of a name; an empty string for a blank one."""
    return F.when(F.btrim(F.coalesce(name, F.lit(""))) == "", F.lit("")).otherwise(F.substring(F.sha1(F.concat(F.lit(salt), name)), 1, 12))


def folded(text: Column) -> Column:
    """White space collapsed, lower case, no dots at the end."""
    return F.regexp_replace(F.lower(F.btrim(F.regexp_replace(text, r"\s+", " "))), r"\.+$", "")


def package_key(text: Column) -> Column:
    """A package number without white space, commas at its ends, and case."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), F.lit(",")))


def stamp_day(stamp: Column) -> Column:
    """``20260913T...`` as ``2026-09-13``."""
    return F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))


def sql_literal(value: Column, kind: str) -> Column:
    """A value as SQL text: NULL, 0/1, the number, or quoted with quotes doubled. ``kind``: its Spark type name."""
    if kind == "boolean":
        shown = value.cast("int").cast("string")
    elif kind in ("string", "date", "timestamp"):
        shown = F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def format_crore(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f crore", value))


def format_amount(crore: Column) -> Column:
    """Crore from one upwards, lakh below."""
    return F.when(crore.isNull(), F.lit("n/a")).when(crore >= 1, F.format_string("%.2f crore", crore)).otherwise(F.format_string("%.1f lakh", crore * 100))


def format_figure(value: Column, kind: str) -> Column:
    """A report's figure: ``pct``, ``multiple`` or ``score``."""
    shown = {"pct": F.format_string("%.1f %%", value * 100), "multiple": F.format_string("%.2fx", value), "score": F.format_string("%.4f", value)}[kind]
    return F.when(value.isNull(), F.lit("n/a")).otherwise(shown)


def is_stale(stamp: Column, now: Column, hours: int = 36) -> Column:
    """Whether a time is more than ``hours`` before ``now``; so is no time."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(stamp) > hours * 3600, F.lit(True))


def days_left(closing: Column, now: Column) -> Column:
    """Whole days from ``now`` (UTC) to a closing minute of a zone six hours ahead."""
    closes = F.try_to_timestamp(closing, F.lit("yyyy-MM-dd'T'HH:mm")) - F.expr("INTERVAL 6 HOURS")
    return F.floor((F.unix_timestamp(closes) - F.unix_timestamp(now)) / 86_400)


def masked_error(text: Column) -> Column:
    """An error with long numbers hidden, 200 characters at most."""
    return F.left(F.regexp_replace(text, r"\d{6,}", "#"), F.lit(200))


def address_hash(address: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), address), 256), 1, 32)


def query_string(params: dict[str, Column], defaults: dict[str, str]) -> Column:
    """``a=1&b=2`` of the values that are neither empty nor the default."""
    shown = [F.when((F.coalesce(c, F.lit("")) != "") & (F.coalesce(c, F.lit("")) != defaults.get(k, "")), F.concat(F.lit(f"{k}="), c)) for k, c in params.items()]
    return F.concat_ws("&", *shown)


def notification(title: Column, entity: Column, ministry: Column, closing: Column, tender_id: Column) -> Column:
    """Struct of a push message: heading, body, url, tag."""
    cut = F.when(F.length(title) > 80, F.concat(F.left(title, F.lit(79)), F.lit("…"))).otherwise(title)
    buyer = F.coalesce(F.nullif(entity, F.lit("")), F.nullif(ministry, F.lit("")), F.lit("A public buyer"))
    closes = F.date_format(F.try_to_timestamp(closing, F.lit("yyyy-MM-dd'T'HH:mm")), "d MMM")
    return F.struct(cut.alias("heading"), F.concat(buyer, F.coalesce(F.concat(F.lit(", closes "), closes), F.lit(""))).alias("body"), F.concat(F.lit("/tenders/"), tender_id).alias("url"), F.concat(F.lit("tender-"), tender_id).alias("tag"))


def conformal_key(method: Column, q50: Column | None = None, edges: list[float] | None = None) -> Column:
    """The group a band is calibrated in: method, with a size bucket where edges are given."""
    if q50 is None or not edges:
        return method
    bucket = sum((F.when(q50 >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.concat_ws("|", method, bucket.cast("string"))
