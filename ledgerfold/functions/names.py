"""Names of firms: one spelling, a block to compare within, and rules that settle a pair."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed word lists that decide which parts of a name identify a firm.
HONORIFICS = ["ms", "md", "mohammad", "mohammed", "mohd", "muhammad", "mst", "most", "mosammat", "sree", "sri", "late", "engr", "engineer", "alhaj", "alhajj", "hajee", "haji", "dr", "prof", "mr", "mrs", "miss", "janab"]
LEGAL = ["ltd", "limited", "pvt", "private", "co", "company", "corporation", "corp", "inc", "and", "sons", "son", "bros", "brother", "brothers", "firm", "the"]
PLURALS = {"enterprises": "enterprise", "traders": "trader", "stores": "store", "suppliers": "supplier", "builders": "builder", "engineers": "engineer", "constructions": "construction", "industries": "industry", "agencies": "agency", "associates": "associate", "services": "service", "works": "work", "brickfields": "brickfield"}


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_name(raw: Column) -> Column:
    """NFKC, lower case, without an M/S prefix, ``&`` as and, punctuation and symbols as spaces, spaces collapsed.

    Names of ASCII alone skip the Python step.
    """
    raw = F.coalesce(raw, F.lit(""))
    text = F.lower(F.btrim(F.when(raw.rlike(r"[^\x00-\x7F]"), _nfkc(raw)).otherwise(raw)))
    text = F.regexp_replace(text, r"^(m\s*/\s*s\.?|messrs\.?|ms\.?)\s+", "")
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"[\p{P}\p{S}]", " ")
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def block_key(normalized: Column) -> Column:
    """The first word of three characters or more, else the first, else nothing."""
    long = F.filter(tokens(normalized), lambda t: F.length(t) >= 3)
    return F.coalesce(F.get(long, F.lit(0)), F.get(tokens(normalized), F.lit(0)), F.lit(""))


def core(normalized: Column) -> Column:
    """Words that identify a firm: singular, no honorifics or legal forms, single letters in a row joined."""
    pairs = F.create_map(*(F.lit(x) for kv in PLURALS.items() for x in kv))
    kept = F.filter(F.transform(tokens(normalized), lambda t: F.coalesce(F.try_element_at(pairs, t), t)), lambda t: ~t.isin(*HONORIFICS, *LEGAL))
    # A letter alone is marked on both sides; marks that meet are where letters join.
    line = F.array_join(F.transform(kept, lambda t: F.when(F.length(t) == 1, F.concat(F.lit("\x01"), t, F.lit("\x01"))).otherwise(t)), " ")
    joined = F.replace(F.replace(line, F.lit("\x01 \x01")), F.lit("\x01"))
    return tokens(joined)


def pair_decision(a: Column, b: Column) -> Column:
    """``merge``, ``keep`` or an empty string (a person must judge) for two normalised names."""
    ca, cb = core(a), core(b)
    only_a, only_b = F.array_except(ca, cb), F.array_except(cb, ca)
    one_a, one_b = F.get(only_a, F.lit(0)), F.get(only_b, F.lit(0))
    single = (F.size(only_a) == 1) & (F.size(only_b) == 1)
    return (
        F.when((F.size(ca) == 0) | (F.size(cb) == 0), F.lit(""))
        .when(F.array_sort(ca) == F.array_sort(cb), F.lit("merge"))
        .when((F.size(only_a) == 0) != (F.size(only_b) == 0), F.lit(""))
        .when(F.exists(F.concat(only_a, only_b), lambda t: t.rlike(r"\d")), F.lit("keep"))
        .when(single & (one_a.startswith(one_b) | one_b.startswith(one_a)), F.lit(""))
        .otherwise(F.lit("keep"))
    )
