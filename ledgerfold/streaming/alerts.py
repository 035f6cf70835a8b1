"""Saved filters against new notices: a batch function, and the same function for every micro-batch of a stream."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ledgerfold.storage import freed, saved

#: Notices looked at in one run, and messages to one subscription in one run.
BATCH, PER_SUBSCRIPTION = 500, 20
#: Notices in a number of bits; different filters that are sent to every task with their bits (more are dealt out).
WORD, SENT_FILTERS = 62, 100_000


def candidates(tenders: DataFrame, at: str, key: str = "", limit: int = BATCH) -> DataFrame:
    """The next live notices after the cursor, earliest first; the id is part of it, so a cut within one fetch time loses none."""
    later = (F.col("fetched_at") > at) | ((F.col("fetched_at") == at) & (F.col("tender_id") > key))
    return tenders.where((F.col("status") == "Live") & later).orderBy("fetched_at", "tender_id").limit(limit)


def fits(children: dict[str, list[str]] | None = None) -> Column:
    """Whether a notice fits a filter ``f`` (q, ministry, status, district, category): all its parts do and it has one.

    A notice has no district, so a filter with one fits none.
    """
    given = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit("")) != ""
    category = F.col("category") == F.col("f.category")
    for parent, kids in (children or {}).items():
        category = category | ((F.col("f.category") == parent) & F.col("category").isin(*kids))
    tests = {"q": F.contains(F.lower("title"), F.lower(F.col("f.q"))), "ministry": F.col("ministry") == F.col("f.ministry"), "status": F.col("status") == F.col("f.status"), "category": category}
    some, ok = F.lit(False), ~given("district")
    for c, test in tests.items():
        some, ok = some | given(c), ok & (~given(c) | F.coalesce(test, F.lit(False)))
    return some & ok


def met(tenders: DataFrame, subscriptions: DataFrame, children: dict[str, list[str]] | None = None) -> DataFrame:
    """(sub_id, tender_id, fetched_at): which of at most BATCH notices fit any filter of which subscription.

    ``subscriptions``: (sub_id, filters array of f). That side of few rows is sent to where the filters are.
    """
    filters = subscriptions.select("sub_id", F.explode("filters").alias("f"))
    notices = F.broadcast(tenders.select("tender_id", "title", "ministry", "status", "category", "fetched_at"))  # BATCH rows
    return filters.join(notices, fits(children)).select("sub_id", "tender_id", "fetched_at").distinct()


def to_send(found: DataFrame, sent: DataFrame, per: int = PER_SUBSCRIPTION) -> DataFrame:
    """What was not sent of ``met``, the earliest ``per`` of each subscription."""
    fresh = found.join(sent.select("sub_id", "tender_id"), ["sub_id", "tender_id"], "left_anti")
    w = Window.partitionBy("sub_id").orderBy("fetched_at", "tender_id")
    return fresh.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per).drop("place")


def matched(tenders: DataFrame, subscriptions: DataFrame, sent: DataFrame, children: dict[str, list[str]] | None = None, per: int = PER_SUBSCRIPTION) -> DataFrame:
    """(sub_id, tender_id, fetched_at) to send for at most BATCH notices: what ``to_send`` leaves of ``met``.

    Equal filters are held against the notices once. Notices are numbered from the earliest, and what a subscription has met and was sent
    is a bit for each, WORD to a number, so its pairs with notices are written only for what is left.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("fetched_at", "tender_id")
    numbered = saved(tenders.select("tender_id", "title", "ministry", "status", "category", "fetched_at", (F.dense_rank().over(order) - 1).alias("place")), "notices")
    words = range((numbered.agg(F.max("place")).first()[0] or 0) // WORD + 1)
    if len(words) * WORD > 4 * BATCH:  # too many columns
        return to_send(met(numbered, subscriptions, children), sent, per)
    ids = numbered.select("tender_id", "fetched_at", "place").distinct()
    bits = lambda: [F.bit_or(F.when(F.floor(F.col("place") / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(WORD)))).otherwise(F.lit(0).cast("bigint"))) for w in words]
    filters = subscriptions.select("sub_id", F.explode("filters").alias("f"))
    found = saved(filters.select("f").distinct().join(F.broadcast(numbered), fits(children)).groupBy("f").agg(*(b.alias(f"met_{w}") for w, b in zip(words, bits()))), "fits")  # BATCH rows
    found = F.broadcast(found) if found.count() <= SENT_FILTERS else found
    held = filters.join(found, "f").groupBy("sub_id").agg(*(F.bit_or(f"met_{w}").alias(f"met_{w}") for w in words))
    gone = sent.where("sub_id is not null").join(F.broadcast(ids.select("tender_id", "place")), "tender_id").groupBy("sub_id").agg(*(b.alias(f"sent_{w}") for w, b in zip(words, bits())))
    left = held.join(gone, "sub_id", "left").select("sub_id", *(F.col(f"met_{w}").bitwiseAND(F.bitwise_not(F.coalesce(f"sent_{w}", F.lit(0).cast("bigint")))).alias(f"left_{w}") for w in words))
    one = F.lit(1).cast("bigint")
    places_of = lambda word, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: word.bitwiseAND(F.call_function("shiftleft", one, b)) != 0), lambda b: b + w * WORD)
    taken, before = [], F.lit(0)
    for w in words:
        word = F.col(f"left_{w}")
        # A word is read only if those before it do not fill the messages.
        taken.append(F.when((word != 0) & (before < per), places_of(word, w)).otherwise(F.array().cast("array<int>")))
        before = before + F.bit_count(word)
    places = left.select("sub_id", F.explode(F.slice(F.concat(*taken), 1, per)).alias("place"))
    return places.join(F.broadcast(ids), "place").select("sub_id", "tender_id", "fetched_at")  # BATCH rows


def pruned(subscriptions: DataFrame, failures: DataFrame) -> DataFrame:
    """Subscriptions without those whose endpoint is gone (404 or 410)."""
    return subscriptions.join(failures.where(F.col("code").isin(404, 410)).select("sub_id").distinct(), "sub_id", "left_anti")


def stream(notices: DataFrame, subscriptions: DataFrame, root: str, children: dict[str, list[str]] | None = None) -> StreamingQuery:
    """Matches every micro-batch of a stream of notices; ``root`` gets the messages (also the record of what was sent) and the checkpoint.

    A batch writes to a folder of its own number, so a batch that is run again replaces what it wrote. Notices of a batch are looked at
    some BATCH at a time, and what each of these parts finds is written before all are ranked.
    """
    out = f"{root}/messages"
    kinds = "sub_id string, tender_id string, fetched_at string"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        live = saved(batch.where("status = 'Live'"), "notices")
        spark.createDataFrame([], kinds).write.mode("ignore").parquet(f"{out}/batch=-1")
        sent = spark.read.schema(f"{kinds}, batch long").parquet(out).where(F.col("batch") != number)
        blocks = -(-2 * live.count() // BATCH) or 1
        part = F.pmod(F.xxhash64("tender_id"), F.lit(blocks))
        found = [saved(met(live.where(part == i), subscriptions, children), "met") for i in range(blocks)]
        every = spark.read.schema(kinds).parquet(*(f for df in found for f in df.inputFiles())) if any(df.inputFiles() for df in found) else found[0]
        to_send(every, sent).write.mode("overwrite").parquet(f"{out}/batch={number}")
        freed(live, *found)

    return notices.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def due(runs: DataFrame) -> DataFrame:
    """``runs`` (ran_at, load) with ``examined``: a run looks at notices only if the load marker has changed since the last run that did.

    Without a marker every run looks. A run that is not the first of its load finds nothing new, so it reads no notices at all.
    """
    marked = F.coalesce("load", F.lit(""))
    before = F.last(F.when(marked != "", marked), ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("ran_at").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("examined", (marked == "") | ~marked.eqNullSafe(before))


def error_text(kind: Column, message: Column) -> Column:
    """What a failed run says in public: kind and message, long numbers masked, 200 characters."""
    return F.left(F.regexp_replace(F.concat_ws(": ", kind, message), r"\d{6,}", "#"), F.lit(200))


#: Counts that a run of alerts records.
RUN_FIGURES = ("candidates", "subscriptions", "matched", "sent", "failed", "pruned")


def recorded(spark: SparkSession, path: str, ran_at: str, run: Callable[[], dict[str, int]], dry: bool = False) -> dict[str, int]:
    """Runs ``run`` and appends a row of its figures to the log at ``path``, also if it failed: then the error goes on. Dry runs leave no row.

    A log that cannot be written costs no alert.
    """
    found: dict[str, int] = {}
    error: BaseException | None = None
    try:
        found = run()
        return found
    except Exception as e:
        error = e
        raise
    finally:
        if not dry:
            row = spark.range(1).select(
                F.lit(ran_at).alias("ran_at"), *(F.lit(int(found.get(c, 0))).cast("long").alias(c) for c in RUN_FIGURES), F.lit(int(error is not None)).alias("errored"),
                (error_text(F.lit(type(error).__name__), F.lit(str(error))) if error is not None else F.lit(None).cast("string")).alias("error"),
            )
            try:
                row.write.mode("append").parquet(path)
            except Exception as e:  # noqa: BLE001 - the run happened, whether it is written down or not
                warnings.warn(f"run not recorded: {e}", stacklevel=2)


def run_summary(log: DataFrame) -> DataFrame:
    """One row of a run log: runs, failed ones, figures in all, the last run and the last error."""
    return log.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("errored").alias("errored"), *(F.sum(c).alias(c) for c in RUN_FIGURES), F.max("ran_at").alias("last_run"),
        F.max_by("error", F.when(F.col("errored") == 1, F.col("ran_at"))).alias("last_error"),
    )


def rate_limited(requests: DataFrame, per_hour: int = 5) -> DataFrame:
    """``requests`` (hash, ts, id) with ``allowed``: at most so many of one hash in the hour up to each, itself included."""
    w = Window.partitionBy("hash").orderBy(F.unix_timestamp("ts")).rangeBetween(-3599, 0)
    return requests.withColumn("in_hour", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("in_hour") <= per_hour)
