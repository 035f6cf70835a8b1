"""Reads behind the pages: filtered lists, facets, one tender with its award, counts and usage."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE, MOST = 25, 100


@dataclass(frozen=True)
class Filters:
    """What a list is asked for; ``status`` is Live unless given, ``all`` asks for any."""

    q: str = ""
    ministry: str = ""
    status: str = "Live"
    category: str = ""
    method: str = ""
    page: int = 1
    size: int = PAGE

    @staticmethod
    def of(params: dict[str, str]) -> Filters:
        """From text; a page below 1 is 1, a size is 1 to 100."""
        number = lambda k, d: int(params[k]) if str(params.get(k, "")).lstrip("-").isdigit() else d
        given = {k: params[k] for k in ("q", "ministry", "status", "category", "method") if params.get(k)}
        return Filters(**given, page=max(1, number("page", 1)), size=min(MOST, max(1, number("size", PAGE))))


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def predicates(f: Filters, children: dict[str, list[str]] | None = None, without: str = "") -> list[Column]:
    """The conjunction a filter stands for, but for ``without``: a facet does not filter itself. Wildcards in ``q`` are plain characters."""
    out = []
    if f.q and without != "q":
        out.append(F.col("title").ilike(f"%{escaped(f.q)}%"))
    if f.status != "all" and without != "status":
        out.append(F.col("status") == f.status)
    for c in ("ministry", "method"):
        if getattr(f, c) and without != c:
            out.append(F.col(c) == getattr(f, c))
    if f.category and without != "category":
        out.append(F.col("category").isin(f.category, *(children or {}).get(f.category, [])))
    return out


def filtered(tenders: DataFrame, f: Filters, children: dict[str, list[str]] | None = None, without: str = "") -> DataFrame:
    found = predicates(f, children, without)
    return tenders.where(reduce(lambda a, b: a & b, found)) if found else tenders


def listed(tenders: DataFrame, f: Filters, children: dict[str, list[str]] | None = None) -> DataFrame:
    """A page of a list, newest first, equal times by id: a top-k without a sort of all rows."""
    return filtered(tenders, f, children).orderBy(F.col("published_at").desc_nulls_last(), "tender_id").offset((f.page - 1) * f.size).limit(f.size)


def facet(tenders: DataFrame, column: str, f: Filters, limit: int, children: dict[str, list[str]] | None = None) -> DataFrame:
    """(value, n) of a column under all other filters, most first."""
    rows = filtered(tenders, f, children, without=column).where(F.coalesce(column, F.lit("")) != "")
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facets(tenders: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass, by grouping sets."""
    sets = tenders.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns))).alias("x"))
    return sets.select("x.*").where(F.coalesce("value", F.lit("")) != "").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def detail(tenders: DataFrame, awards: DataFrame, tender_id: str | None = None) -> DataFrame:
    """A tender (or all) with what it was awarded for, where it was."""
    of = tenders if tender_id is None else tenders.where(F.col("tender_id") == tender_id)
    return of.join(awards.select("tender_id", "awardee", "signed_on", "value_crore", "bidder_id"), "tender_id", "left")


def summary(tenders: DataFrame, awards: DataFrame) -> DataFrame:
    """One row of counts and latest times."""
    t = tenders.agg(F.count(F.lit(1)).alias("tenders"), F.count_if(F.col("status") == "Live").alias("live"), F.max("published_at").alias("last_published"), F.max("fetched_at").alias("last_fetched"))
    a = awards.agg(F.count(F.lit(1)).alias("contracts"), F.countDistinct("bidder_id").alias("bidders"), F.max("signed_on").alias("last_signed"))
    return t.crossJoin(F.broadcast(a))  # one row each


def usage(events: DataFrame, now: Column) -> DataFrame:
    """One row: users, events and value in the last 7 and 30 days and altogether."""
    week, month = F.col("ts") > now - F.expr("INTERVAL 7 DAYS"), F.col("ts") > now - F.expr("INTERVAL 30 DAYS")
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(week).alias("events_7d"), F.count_if(month).alias("events_30d"), F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.when(week, F.col("user_id"))).alias("users_7d"), F.countDistinct(F.when(month, F.col("user_id"))).alias("users_30d"), F.max("ts").cast("string").alias("last_event"), F.round(F.sum(F.when(month, F.col("value"))), 2).alias("value_30d"),
    )


def parsed_list(text: Column, kind: str = "array<string>") -> Column:
    """JSON text as a list; an empty one where it is not."""
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def request_faults(name: Column, email: Column, message: Column, trap: Column, most: int = 2000) -> Column:
    """What is wrong with an access request, as a list."""
    return F.array_compact(F.array(
        F.when(F.length(F.btrim(F.coalesce(name, F.lit("")))) == 0, "name"), F.when(~F.coalesce(email, F.lit("")).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email"),
        F.when(F.length(F.coalesce(message, F.lit(""))) > most, "message"), F.when(F.coalesce(trap, F.lit("")) != "", "trap"),
    ))


def cached(spark: SparkSession, path: str, name: str, marker: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A summary of a few rows, computed once for each load: read from the table at ``path`` if it was kept under this marker.

    Without a marker nothing is kept. A kept value of another load, or one that cannot be read, is computed again; a write that fails only
    means that the next call computes too. Of two that write at once either may be read: they are of the same load.
    """
    at = f"{path}/{name}/load={quote(marker, safe='')}"
    if marker:
        try:
            return spark.read.parquet(at)
        except AnalysisException:
            pass
    made = compute()
    if not marker:
        return made
    try:
        made.coalesce(1).write.mode("overwrite").parquet(at)
        return spark.read.schema(made.schema).parquet(at)
    except Exception as e:  # noqa: BLE001 - a summary that is not kept is still one
        warnings.warn(f"summary not kept: {e}", stacklevel=2)
        return made


def cache_key(f: Filters) -> str | None:
    """The name under which the default views are kept; None for any other, so that odd requests cannot fill the table."""
    narrowed = f.q or f.ministry or f.category or f.method or f.page != 1
    return None if narrowed or f.status not in ("Live", "all") else f"filters-{f.status}"
