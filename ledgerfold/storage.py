"""Tables in the folder that the driver and all executors share.

What is iterated on or read more than once is written there as Parquet: its lineage ends, and a lost executor costs a reread.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Spark then deletes what a write has shuffled as soon as the write ends, so that the shuffles of one step do not lie beside those of the next.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's own process; ``local-cluster`` has executors of its own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of the warehouse (or, on a local master, a temporary one)."""
    if found := spark.conf.get(SETTING, None):
        return found.rstrip("/")
    found = f"file://{tempfile.mkdtemp(prefix='ledgerfold-')}" if is_local(spark) else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    spark.conf.set(SETTING, found)
    return found


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """``df`` as by ``saved``, marked to go to every task in a join if it has at most so many rows; the result of a join is the same."""
    made = saved(df, name)
    return F.broadcast(made) if made.count() <= rows else made


def freed(*tables: DataFrame) -> None:
    """Deletes tables made by ``saved`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm, shared = spark._jvm, shared_dir(spark).rpartition(":")[2]
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if shared in folder.toString() and len(folder.getName().rpartition("-")[2]) == 32:
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(taken: list[str], name: str) -> str:
    """``name``, with as many underscores as it needs to differ from all ``taken`` columns."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
