"""Typed rows from list, detail and plan pages: one tokenizer run in batches, everything after it in expressions."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.functions import scalars as S

#: Marks around a hidden id within a cell's text.
MARK = "\x00"
NOTE = r"(?i)Corrigendum|Amendment"
DATE = r"\d{2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2}"


#: A tag (closing slash, name, attributes) or the text between tags.
TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?-->|<![^>]*>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


def table_cells(page: str) -> tuple[list[list[str]], dict[str, str]]:
    """Texts of the cells of each table row, and values of hidden inputs by id.

    br and p break lines within a cell; a hidden input named id leaves a mark there.
    """
    rows: list[list[str]] = []
    hidden: dict[str, str] = {}
    cell: list[str] | None = None
    for closing, name, rest, text in TOKEN.findall(page):
        name = name.lower()
        if text and cell is not None:
            cell.append(unescape(text))
        elif name in ("td", "tr"):
            if cell is not None:
                rows[-1].append("".join(cell))
            cell = [] if name == "td" and not closing and rows else None
            if name == "tr" and not closing:
                rows.append([])
        elif name in ("br", "p") and not closing and cell is not None:
            cell.append("\n")
        elif name == "input":
            at = {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)}
            if at.get("type", "").lower() == "hidden":
                if at.get("id"):
                    hidden[at["id"]] = at.get("value", "")
                if at.get("name") == "id" and cell is not None:
                    cell.append(f"{MARK}id={at.get('value', '')}{MARK}")
    return [r for r in rows if r], hidden


@F.pandas_udf(T.StructType([T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("total", T.StringType())]))
def tokenized(pages: pd.Series) -> pd.DataFrame:
    found = [table_cells(page or "") for page in pages]
    return pd.DataFrame([(rows, hidden.get("totalPages")) for rows, hidden in found], columns=["cells", "total"])


def lines(cell: Column) -> Column:
    """Lines of a cell without marks, blanks and commas at their ends."""
    bare = F.transform(F.split(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\x00id=\d*\x00", ""), "\n"), lambda x: F.btrim(F.btrim(F.btrim(x, F.lit(" \t\r\n")), F.lit(",")), F.lit(" \t\r\n")))
    return F.filter(bare, lambda x: x != "")


def _line(lines_: Column, i: int) -> Column:
    return F.coalesce(F.get(lines_, F.lit(i)) if i >= 0 else F.when(F.size(lines_) >= -i, F.get(lines_, F.size(lines_) + i)), F.lit(""))


def _rows(pages: DataFrame, html: str, least: int, keep: list[str]) -> DataFrame:
    """One row for each table row of ``least`` cells or more that begins with a number, as ``c``."""
    each = pages.select(*keep, F.explode(tokenized(F.col(html))["cells"]).alias("c"))
    return each.where((F.size("c") >= least) & F.btrim(F.get("c", F.lit(0)), F.lit(" \t\r\n")).rlike(r"^\d+$"))


def tender_rows(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a notice list."""
    c = lambda i: F.get("c", F.lit(i))
    cut = _rows(pages, html, 6, list(keep)).select(*keep, c(2).alias("t"), lines(c(1)).alias("id"), lines(c(2)).alias("ti"), lines(c(3)).alias("org"), lines(c(4)).alias("ty"), F.regexp_extract_all(c(5), F.lit(f"({DATE})"), 1).alias("dates"))
    last = F.when(F.size("id") > 2, _line(F.col("id"), -1)).otherwise("")
    note = (last != "") & last.rlike(NOTE)
    marked = F.regexp_extract("t", r"\x00id=(\d+)\x00", 1)
    org = F.col("org")
    return cut.select(
        *keep, F.when(marked != "", marked).otherwise(_line(F.col("id"), 0)).alias("tender_id"), _line(F.col("id"), 1).alias("reference"), F.when(note, "").otherwise(last).alias("status"), F.when(note, last).otherwise("").alias("note"),
        _line(F.col("ti"), 0).alias("nature"), F.array_join(F.slice("ti", 2, 1_000), " ").alias("title"), _line(org, 0).alias("ministry"),
        F.when(F.size(org) > 2, F.array_join(F.slice(org, 2, F.greatest(F.size(org) - 2, F.lit(0))), " / ")).otherwise("").alias("organization"), F.when(F.size(org) > 1, _line(org, -1)).otherwise("").alias("procuring_entity"),
        _line(F.col("ty"), 0).alias("procurement_type"), F.when(F.size("ty") > 1, _line(F.col("ty"), -1)).otherwise("").alias("method"),
        S.parse_datetime(F.get("dates", F.lit(0))).alias("published_at"), S.parse_datetime(F.get("dates", F.lit(1))).alias("closing_at"),
    )


def contract_rows(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of an award list."""
    c = lambda i: F.get("c", F.lit(i))
    cut = _rows(pages, html, 8, list(keep)).select(*keep, "c", lines(c(2)).alias("ti"), lines(c(3)).alias("pe"))
    head = _line(F.col("ti"), 0)
    rest = F.slice("ti", 2, 1_000)
    # A date stands at the end of the title's last line; it and what follows go.
    trimmed = F.transform(rest, lambda x, i: F.when(i == F.size("ti") - 2, F.btrim(F.regexp_extract(x, f"(?s)^(.*?)(?:{DATE}.*)?$", 1))).otherwise(x))
    title = F.btrim(F.replace(F.array_join(F.filter(trimmed, lambda x: (x != "") & ~F.lower(x).isin("more", "less", "...")), " "), F.lit("...")))
    pe = F.col("pe")
    return cut.select(
        *keep, F.btrim(F.substring_index(head, ",", 1)).alias("tender_id"), F.when(F.instr(head, ",") > 0, F.btrim(F.regexp_replace(head, r"^[^,]*,", ""))).otherwise("").alias("reference"), title.alias("title"), S.parse_datetime(c(2)).alias("advertised_at"),
        F.array_join(lines(c(1)), " / ").alias("ministry"), F.when(F.size(pe) > 1, F.array_join(F.slice(pe, 1, F.greatest(F.size(pe) - 1, F.lit(0))), " ")).otherwise(_line(pe, 0)).alias("procuring_entity"), F.when(F.size(pe) > 1, _line(pe, -1)).otherwise("").alias("method"),
        F.array_join(lines(c(4)), " ").alias("district"), S.parse_day(c(5)).alias("signed_on"), F.array_join(lines(c(6)), " ").alias("awardee"), S.parse_number(c(7)).alias("value_crore"),
    )


def details(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``labels`` (map of a label's text to the cell beside it, the first of equals) and ``security_bdt`` (sum over lots, or null)."""
    cells = pages.select(*keep, tokenized(F.col(html))["cells"].alias("rows"))
    collapse = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))
    pairs = F.flatten(F.transform("rows", lambda r: F.filter(F.zip_with(r, F.slice(r, 2, 1_000), lambda a, b: F.struct(F.rtrim(collapse(a)).alias("k"), F.array_join(lines(b), " ").alias("v"))), lambda p: p["v"].isNotNull() & p["k"].endswith(":"))))
    named = F.filter(F.transform(pairs, lambda p: F.struct(F.btrim(F.rtrim(p["k"], F.lit(":"))).alias("k"), p["v"].alias("v"))), lambda p: p["k"] != "")
    first = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    lots = F.filter("rows", lambda r: (F.size(r) == 6) & F.lower(F.btrim(F.get(r, F.lit(0)), F.lit(" \t\r\n"))).rlike(r"^(\d+|single)$"))
    amounts = F.filter(F.transform(lots, lambda r: S.parse_int(F.get(r, F.lit(3)))), lambda x: x.isNotNull())
    return cells.select(*keep, first.alias("labels"), F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("security_bdt"))


def detail_fields(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The named fields of ``details``; text that is missing is empty."""
    at = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    brief = F.coalesce(*(F.nullif(at(f"Brief Description of {x}"), F.lit("")) for x in ("Goods and Related Service", "Works", "Services")), F.lit(""))
    return found.select(
        *keep, digits(at("Tender/Proposal ID")).alias("tender_id"), at("Ministry").alias("ministry"), at("Procuring Entity Name").alias("procuring_entity"), at("Procuring Entity District").alias("procuring_entity_district"),
        at("Procurement Nature").alias("nature"), at("Procurement Method").alias("method"), at("Budget Type").alias("budget_type"), at("Source of Funds").alias("source_of_funds"), digits(at("App ID")).alias("app_id"),
        F.filter(F.transform(F.split(at("Category"), ";"), lambda x: F.btrim(x)), lambda x: x != "").alias("categories"), S.parse_datetime(at("Tender/Proposal Closing Date and Time")).alias("closing_at"),
        S.parse_int(at("Tender/Proposal Document Price (In BDT)")).alias("document_price_bdt"), "security_bdt", brief.alias("brief"),
    )


def plan_rows(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Package lines of a plan page, in expressions alone."""
    text = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))
    rows = pages.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("r"))
    cells = rows.select(*keep, F.regexp_extract_all("r", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1).alias("c"))
    c = lambda i: F.get("c", F.lit(i))
    good = cells.where((F.size("c") >= 7) & text(c(1)).rlike(r"^\d+$"))
    cost = text(c(6))
    return good.select(
        *keep, text(c(1)).alias("app_id"), F.rtrim(text(c(4)), F.lit(",")).alias("nature"), F.btrim(F.rtrim(text(F.substring_index(c(5), "<br", 1)), F.lit(","))).alias("package_no"), F.regexp_extract(c(5), r"pkgId=(\d+)", 1).alias("pkg_id"),
        F.btrim(F.substring_index(cost, ",", 1)).try_cast("double").alias("estimate_bdt"), F.when(F.instr(cost, ",") > 0, F.btrim(F.regexp_replace(cost, r"^[^,]*,", ""))).otherwise("").alias("plan_method"),
    )


def matched_packages(wanted: DataFrame, plans: DataFrame) -> DataFrame:
    """``wanted`` (tender_id, app_id, package_no) with the plan line of exactly that package; none where none or several fit."""
    plans = plans.withColumn("__k", S.package_key(F.col("package_no"))).where("__k <> ''").select("app_id", "__k", F.col("estimate_bdt"), F.col("pkg_id"))
    lone = plans.groupBy("app_id", "__k").agg(F.count(F.lit(1)).alias("n"), F.max("estimate_bdt").alias("estimate_bdt"), F.max("pkg_id").alias("pkg_id")).where("n = 1").drop("n")
    return wanted.withColumn("__k", S.package_key(F.col("package_no"))).join(lone, ["app_id", "__k"], "left").drop("__k").withColumn("matched", F.col("pkg_id").isNotNull())
