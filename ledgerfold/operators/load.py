"""Incremental loads under a daily budget of writes: what goes first, how far it gets, and the statements that carry it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.functions.scalars import sql_literal

#: Writes a row of each table costs with its indexes.
WEIGHTS = {"tenders": 8, "predictions": 1, "procuring_entities": 2, "bidders": 2}
MAX_WRITES, ROWS, BYTES, PER_FILE, RETRIES, LOOKBACK_DAYS = 40_000, 200, 90_000, 20, 3, 3


@dataclass(frozen=True)
class Cursor:
    """How far a stream is loaded: rows of a fetch time share it, so the id is part of it."""

    at: str = ""
    key: str = ""


@dataclass(frozen=True)
class Watermark:
    day: str = ""
    writes_today: int = 0
    live: Cursor = Cursor()
    backlog: Cursor = Cursor()
    bidders: str = ""
    bidders_after: str = ""


def left_today(mark: Watermark, today: str, most: int = MAX_WRITES, per_run: int | None = None) -> int:
    used = mark.writes_today if mark.day == today else 0
    return max(0, min(most - used, per_run or most))


def after(df: DataFrame, cursor: Cursor, at: str = "fetched_at", key: str = "tender_id") -> DataFrame:
    """Rows beyond a cursor: later ones, and those of its time with a greater id."""
    t = F.coalesce(at, F.lit(""))
    return df.where((t > cursor.at) | ((t == cursor.at) & (F.col(key) > cursor.key)))


def planned(queue: DataFrame, budget: int) -> DataFrame:
    """``queue`` (part, priority, weight, at, key) with ``cost`` (writes up to and with the row) and ``taken``.

    Weights are equal within a part, so a part's rows are ranked by themselves and only its total moves the parts after it: the sums
    over parts are a handful of rows, and ranks within a part come from counts of its distinct times.
    """
    totals = queue.groupBy("part", "priority").agg(F.sum("weight").alias("total"))
    before = Window.partitionBy(F.lit(1)).orderBy("priority", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0))).select("part", "start")
    times = queue.groupBy("part", "at").agg(F.sum("weight").alias("w"))
    by_time = times.withColumn("earlier", F.coalesce(F.sum("w").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", F.col("at").alias("__at"), "earlier")
    placed = queue.join(F.broadcast(starts), "part").join(by_time.withColumnRenamed("part", "__part"), (F.col("part") == F.col("__part")) & F.col("at").eqNullSafe(F.col("__at"))).drop("__at", "__part")
    own = F.sum("weight").over(Window.partitionBy("part", "at").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    cost = placed.withColumn("cost", F.col("start") + F.col("earlier") + own)
    return cost.withColumn("taken", F.col("cost") <= budget).drop("start", "earlier")


def advanced(mark: Watermark, plan: DataFrame, today: str) -> Watermark:
    """The watermark once everything taken is confirmed."""
    taken = plan.where("taken")
    last = {r["part"]: r for r in taken.groupBy("part").agg(F.max(F.struct("at", "key")).alias("m"), F.sum("weight").alias("w")).collect()}
    cursor = lambda part, was: Cursor(last[part]["m"]["at"] or "", last[part]["m"]["key"]) if part in last else was
    used = mark.writes_today if mark.day == today else 0
    return replace(mark, day=today, writes_today=used + sum(int(r["w"]) for r in last.values()), live=cursor("tenders_live", mark.live), backlog=cursor("tenders_backlog", mark.backlog))


def bidder_load(bidders: DataFrame, mark: Watermark, budget: int, today: str) -> tuple[DataFrame, Watermark]:
    """The bidders (bidder_id, last_award, ...) that a run loads, ``budget`` writes at most, and the watermark once they are confirmed.

    The first load goes through all by id, over as many runs as it takes, and ends at the latest award. After it, a run takes those awarded
    since LOOKBACK_DAYS before the watermark, newest first, as awards are published late; the watermark moves only if all of them fit.
    """
    rows = bidders.withColumn("bidder_id", F.col("bidder_id").cast("string"))
    most = budget // WEIGHTS["bidders"]
    if not mark.bidders:
        pending, order = rows.where(F.col("bidder_id") > mark.bidders_after), [F.col("bidder_id")]
    else:
        since = (date.fromisoformat(mark.bidders) - timedelta(days=LOOKBACK_DAYS)).isoformat()
        pending, order = rows.where(F.coalesce("last_award", F.lit("")) >= since), [F.col("last_award").desc_nulls_last(), F.col("bidder_id")]
    taken = pending.orderBy(*order).limit(most)
    whole = pending.count() <= most
    newest, last = taken.agg(F.max("last_award"), F.max("bidder_id")).first()
    if mark.bidders:
        return taken, replace(mark, bidders=max(newest, mark.bidders)) if whole and newest else mark
    if not whole:
        return taken, replace(mark, bidders_after=last or mark.bidders_after)
    return taken, replace(mark, bidders=rows.agg(F.max("last_award")).first()[0] or today, bidders_after="")


MARKER = "last_load"


def with_marker(todo: list[str], token: str) -> list[str]:
    """The statements and one more, which can only be there if all before it ran."""
    return [*todo, f"INSERT OR REPLACE INTO meta (key, value) VALUES ('{MARKER}', '{token.replace(chr(39), chr(39) * 2)}');"]


def committed(todo: list[str], token: str, run: Callable[[str], bool], read: Callable[[str], str | None], before: Watermark, after: Watermark, wait: Callable[[float], None] = time.sleep) -> Watermark:
    """The watermark after a load: ``after`` only if every statement ran and the marker, read back, is this load's."""
    marked = with_marker(todo, token)
    return after if executed(marked, run, wait) == len(marked) and read(MARKER) == token else before


def confirmed(loads: DataFrame) -> DataFrame:
    """(stream, mark) of the last confirmed load of each stream; ``loads``: (stream, run, mark, token, statements, done, read_back).

    A load is confirmed if all its statements are done and its token was read back; later ones that are not leave the mark where it was.
    """
    ok = (F.col("done") == F.col("statements")) & F.col("read_back").eqNullSafe(F.col("token"))
    return loads.groupBy("stream").agg(F.max_by("mark", F.when(ok, F.col("run"))).alias("mark"), F.count_if(ok).alias("confirmed"), F.count_if(~ok).alias("failed"))


def statements(df: DataFrame, table: str, order: list[str], rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """(file, statement): multi-row upserts of at most ``rows`` rows and ``size`` bytes, PER_FILE statements a file.

    Rows are rendered as text by expressions; filling statements up is greedy, so each ordered partition does it for itself.
    """
    kinds = dict(df.dtypes)
    value = F.concat(F.lit("("), F.concat_ws(", ", *(sql_literal(F.col(c), kinds[c]) for c in df.columns)), F.lit(")"))
    head = f"INSERT OR REPLACE INTO {table} ({', '.join(df.columns)}) VALUES\n"

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, used, made = [], len(head.encode()), 0
        done = lambda: pd.DataFrame({"file": [made // PER_FILE], "statement": [head + ",\n".join(chunk) + ";"]})
        for batch in batches:
            for text in batch["value"]:
                more = len(text.encode()) + 2
                if chunk and (len(chunk) >= rows or used + more > size):
                    yield done()
                    chunk, used, made = [], len(head.encode()), made + 1
                chunk.append(text)
                used += more
        if chunk:
            yield done()

    keyed = df.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(order)), value.alias("value"))
    keys = [f"__k{i}" for i in range(len(order))]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").mapInPandas(fill, "file long, statement string")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """``table`` with ``rows`` put in by key; columns in ``keep`` stay as they were where the key was there."""
    keep = keep or []
    kept = table.select(*keys, *(F.col(c).alias(f"__{c}") for c in keep))
    fresh = rows.join(kept, keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in table.columns))
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(fresh)


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those ``rows`` whose key it lacks, one for each."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def deleted(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def executed(todo: list[str], run: Callable[[str], bool], wait: Callable[[float], None] = time.sleep) -> int:
    """Runs statements with retries and growing pauses; stops at the first that keeps failing. How many were done."""
    for done, statement in enumerate(todo):
        for attempt in range(1, RETRIES + 1):
            if run(statement):
                break
            if attempt == RETRIES:
                return done
            wait(5 * attempt)
    return len(todo)
