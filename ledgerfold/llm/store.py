"""Helpers that the corpus operators share: tables in the shared folder, folds, and bounded samples for fits."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.storage import freed, saved, unused

__all__ = ["bounded_sample", "fold", "freed", "labelled_sample", "learned", "nearby", "saved", "small_batches", "unused"]

#: Rows of an Arrow batch at most, where whole texts go to Python: a batch of long texts is held whole on both sides.
BATCH_ROWS = 1_000
#: Rows of a table that is sent to every executor at most; such tables hold keys and hashes, 100 bytes a row.
FEW = 100_000

T = TypeVar("T")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends BATCH_ROWS rows to Python at once at most."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def nearby(df: DataFrame, rows: int, most: int = FEW) -> DataFrame:
    """``df`` of ``rows`` narrow rows, sent to every executor where these are ``most`` at most; a join deals out both sides else."""
    return F.broadcast(df) if rows <= most else df


def fold(column, modulus: int):
    """crc32 of the column as text, modulo ``modulus``; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int, chars: int) -> DataFrame:
    """(key, y, text) of about ``rows`` documents with a label of 0 or 1 and ``chars`` characters at most, chosen by a hash of the key.

    The labels are sampled first, so what meets the documents has ``rows`` rows at most (and a few hundredths by chance) and no text is
    shuffled. A key with several labels has the greatest.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null").groupBy("key").agg(F.max("y").alias("y"))
    share = min(1.0, rows / max(marks.count(), 1))
    few = marks.where(F.pmod(F.xxhash64("key", F.lit(20_021)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return bounded_sample(saved(texts.join(F.broadcast(few), "key"), "labelled"), F.col("key"), F.col("text"), rows, chars)


def bounded_sample(df: DataFrame, key, text, rows: int, chars: int) -> DataFrame:
    """About ``rows`` rows and ``chars`` characters of ``df`` at most, chosen by a hash of ``key``.

    One aggregate over lengths fixes the share; every run over the same rows picks the same ones.
    """
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    share = min(1.0, rows / max(n, 1), chars / max(total, 1))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key, F.lit(20_011)), F.lit(1_000_000)) < int(share * 1_000_000))


def learned(sample: DataFrame, fit: Callable[[pa.Table], T]) -> T:
    """``fit`` over all rows of a bounded sample, in one task of an executor: only the model comes to the driver."""
    schema = sample.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        yield pa.record_batch([pa.array([pickle.dumps(fit(table), 5)], pa.binary())], names=["model"])

    found = small_batches(sample).repartition(1).mapInArrow(run, "model binary").head()
    return fit(schema.empty_table()) if found is None else pickle.loads(found["model"])
