"""Crawls as streams: unseen rows of each batch go to the lake; and windows over event time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.sources import lake

#: Pages of a delta at most, pages between two writes, and failures in a row that end a crawl.
DELTA_PAGES, FLUSH, FAILURES = 50, 50, 3
#: Failures in a row that end a collection of single pages.
COLLECT_FAILURES = 5


def files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deltas(rows: DataFrame, root: str, endpoint: str) -> StreamingQuery:
    """Appends the rows of each batch whose id the lake lacks, one for each id; a batch that is run again finds its own ids there."""

    def run(batch: DataFrame, number: int) -> None:
        known = lake.known_ids(batch.sparkSession, root, endpoint)
        fresh = lake.unseen(batch.withColumn("tender_id", F.col("tender_id").cast("string")).dropDuplicates(["tender_id"]), known)
        lake.append(fresh.drop("fetched_at"), root, endpoint)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoints/{endpoint}").trigger(availableNow=True).start()


def crawl(fetch: Callable[[int], tuple[list[dict], int]], write: Callable[[list[dict]], None], known: Callable[[list[str]], set[str]] | None, start: int = 1, most: int | None = None, save: Callable[[int, int], None] = lambda page, total: None, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> str:
    """Pages in order from ``start``. With ``known`` (a delta) it stops at a page without a new id; rows go out before the page is saved.

    Returns ``done``, ``stopped`` (page limit, or ``seconds`` are over: the next run goes on from there) or ``failed`` (too many failures in a row).
    """
    held, page, failures, total, began = [], start, 0, 0, clock()
    while most is None or page < start + most:
        if seconds is not None and clock() - began > seconds:
            if held:
                write(held)
            save(page - 1, total)
            return "stopped"
        try:
            rows, total = fetch(page)
        except Exception:  # noqa: BLE001 - any failure of a page counts
            failures += 1
            if failures >= FAILURES:
                if held:
                    write(held)
                return "failed"
            continue
        failures = 0
        fresh = rows
        if known is not None:
            old = known([str(r["tender_id"]) for r in rows])
            fresh = [r for r in rows if str(r["tender_id"]) not in old]
        if not fresh and (known is not None or page > total):
            break
        held += fresh
        if len(held) and (page - start + 1) % FLUSH == 0:
            write(held)
            held = []
            save(page, total)
        page += 1
        if total and page > total:
            break
    if held:
        write(held)
    save(page - 1, total)
    return "done" if most is None or page < start + most else "stopped"


def collect(ids: Iterable[str], fetch: Callable[[str], dict | None], write: Callable[[list[dict]], None], seconds: float | None = None, clock: Callable[[], float] = time.monotonic, flush: int = FLUSH) -> str:
    """One page for each id. A page that is not there leaves a stub, (tender_id, missing), so that it is not asked for again.

    Rows go out every ``flush`` of them and at the end, also after a failure. Returns ``done``, ``stopped`` (time) or ``failed``.
    """
    held: list[dict] = []
    failures, began = 0, clock()
    outcome = "done"
    for key in ids:
        if seconds is not None and clock() - began > seconds:
            outcome = "stopped"
            break
        try:
            row = fetch(key)
        except Exception:  # noqa: BLE001 - any failure of a page counts
            failures += 1
            if failures >= COLLECT_FAILURES:
                outcome = "failed"
                break
            continue
        failures = 0
        held.append({"tender_id": key, "missing": row is None} | (row or {}))
        if len(held) >= flush:
            write(held)
            held = []
    if held:
        write(held)
    return outcome


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
