"""The append-only lake: parts per endpoint, the latest row of each key on read, compaction, clean tables."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerfold.schemas import ENDPOINTS

#: Bytes of loose parts that one compact file stands for.
COMPACT_BYTES = 128 << 20


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S%fZ")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, cast where they can be, null where they are missing; further columns follow."""
    have = set(df.columns)
    declared = [(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return df.select(*declared, *(c for c in df.columns if c not in schema.fieldNames()))


def append(df: DataFrame, root: str, endpoint: str, fetched_at: str | None = None) -> None:
    """Adds parts stamped with one fetch time; the committer makes them visible at once."""
    df.withColumn("fetched_at", F.lit(fetched_at or stamp())).write.mode("append").option("compression", "zstd").parquet(f"{root}/raw/{endpoint}")


def _schemas(spark: SparkSession, files: list[str]) -> tuple[list[tuple[T.StructType, list[str]]], list[str]]:
    """Files grouped so that the schemas of a group merge, and those that cannot be read.

    Spark merges the schemas of many files in one distributed job; a list with a misfit is halved until the misfits stand alone.
    """
    if not files:
        return [], []
    try:
        return [(spark.read.option("mergeSchema", True).parquet(*files).schema, files)], []
    except Exception as e:  # noqa: BLE001 - a corrupt part must not stop the others
        if len(files) == 1:
            warnings.warn(f"part skipped, it cannot be read: {files[0]} ({str(e)[:120]})", stacklevel=3)
            return [], files
    half = len(files) // 2
    (one, bad), (two, worse) = _schemas(spark, files[:half]), _schemas(spark, files[half:])
    by_schema: dict[str, list[str]] = {}
    for kind, of in [*one, *two]:
        by_schema.setdefault(kind.json(), []).extend(of)
    return [(T.StructType.fromJson(json.loads(kind)), of) for kind, of in by_schema.items()], [*bad, *worse]


def _files(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet") and f.getLen() > 12)


def _united(spark: SparkSession, groups: list[tuple[T.StructType, list[str]]], endpoint: str, strict: bool) -> DataFrame:
    read = spark.read.option("ignoreCorruptFiles", not strict)
    frames = [conformed(read.schema(kind).parquet(*of), ENDPOINTS[endpoint]).withColumn("__file", F.col("_metadata.file_path")) for kind, of in groups]
    return union_relaxed(frames) if frames else spark.createDataFrame([], ENDPOINTS[endpoint]).withColumn("__file", F.lit(""))


def parts(spark: SparkSession, root: str, endpoint: str) -> DataFrame:
    """All readable rows of an endpoint with a column ``__file``; unreadable parts are skipped with a warning, types of parts may differ.

    Parts are grouped by schema, so that an id stored as a number in one and as text in another still unites.
    """
    path = f"{root}/raw/{endpoint}"
    return _united(spark, _schemas(spark, _files(spark, path) if exists(spark, path) else [])[0], endpoint, strict=False)


def union_relaxed(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by name; missing columns are null and columns whose types differ become text."""
    frames = list(frames)
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for c, kind in df.dtypes:
            kinds.setdefault(c, set()).add(kind)
    clash = {c for c, k in kinds.items() if len(k - {"void"}) > 1}
    out = None
    for df in frames:
        df = df.withColumns({c: F.col(c).cast("string") for c in df.columns if c in clash})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key by ``order``; every column that could tie should be in it."""
    w = Window.partitionBy(*keys).orderBy(*((F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order))
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def load_all(spark: SparkSession, root: str, endpoint: str) -> DataFrame:
    """The latest row of each tender; ties of the fetch time go to the later file, then to the greater row."""
    return latest_rows(parts(spark, root, endpoint))


def latest_rows(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("tender_id", F.col("tender_id").cast("string"))
    columns = [c for c in rows.columns if c != "__file"]
    return latest_per_key(rows, ["tender_id"], ["fetched_at", "__file", F.to_json(F.struct(*columns))]).drop("__file")


def known_ids(spark: SparkSession, root: str, endpoint: str) -> DataFrame:
    return parts(spark, root, endpoint).select(F.col("tender_id").cast("string").alias("tender_id")).distinct()


def unseen(df: DataFrame, known: DataFrame, key: str = "tender_id") -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def compact(spark: SparkSession, root: str, endpoint: str, min_parts: int = 20) -> bool:
    """Merges loose parts into compact files with the latest row of each key, then deletes those it has read; earlier compact files stay.

    Below ``min_parts`` loose parts nothing happens. Parts that cannot be read stay where they are; one that fails while it is read ends the
    compaction with nothing deleted. A crash between writing and deleting leaves rows twice, which reading resolves.
    """
    path = f"{root}/raw/{endpoint}"
    if not exists(spark, path):
        return False
    fs, at = _fs(spark, path)
    loose = [f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getPath().getName().endswith(".parquet")]
    if len(loose) < min_parts:
        return False
    groups, _ = _schemas(spark, sorted(f.getPath().toString() for f in loose if f.getLen() > 12))
    consumed = [file for _, of in groups for file in of]
    if not consumed:
        return False
    rows = _united(spark, groups, endpoint, strict=True)
    kept = latest_rows(rows)
    made, size = f"{path}/_compacting", {f.getPath().toString(): f.getLen() for f in loose}
    kept.coalesce(-(-sum(size[x] for x in consumed) // COMPACT_BYTES)).write.mode("overwrite").option("compression", "zstd").parquet(made)
    _, made_at = _fs(spark, made)
    now = stamp()
    for i, f in enumerate(f for f in fs.listStatus(made_at) if f.getPath().getName().endswith(".parquet")):
        fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/compact-{now}-{i:05d}.parquet"))
    for name in consumed:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), False)
    fs.delete(made_at, True)
    return True


def write_clean(df: DataFrame, root: str, name: str) -> None:
    """Replaces a clean table: written beside, then renamed over the old one."""
    spark, path = df.sparkSession, f"{root}/clean/{name}.parquet"
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.new")
    fs, at = _fs(spark, path)
    fs.delete(at, True)
    fs.rename(_fs(spark, f"{path}.new")[1], at)


def read_clean(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    path = f"{root}/clean/{name}.parquet"
    return conformed(spark.read.parquet(path), schema) if exists(spark, path) else spark.createDataFrame([], schema)


def seeded_pick(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in an order that follows from the seed: by MD5 of seed and key, equal ones by key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), key).limit(n)


def newest_id(df: DataFrame, key: str = "tender_id") -> Column:
    """Aggregate: the greatest id as a number, blank ones as 0."""
    return F.max(F.coalesce(F.col(key).try_cast("bigint"), F.lit(0)))


def last_runs(runs: DataFrame, stamp_col: str, n: int) -> DataFrame:
    """The newest ``n`` distinct runs, oldest first."""
    return latest_per_key(runs, [stamp_col], [F.to_json(F.struct(*runs.columns))]).orderBy(F.desc(stamp_col)).limit(n).orderBy(stamp_col)
