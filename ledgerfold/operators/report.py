"""Reports that a run writes from its own figures, and the check that nobody edited them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy_page(figures: DataFrame) -> str:
    """Markdown of (figure, now, spread): a handful of rows, in order of their names."""
    shown = figures.select("figure", F.format_string("%.4f", "now").alias("now"), F.format_string("%.4f", "spread").alias("spread")).orderBy("figure").collect()
    head = ["# Accuracy", "", "| Figure | Now | Spread |", "|---|---|---|"]
    return "\n".join([*head, *(f"| {r['figure'].replace('_', ' ')} | {r['now']} | {r['spread']} |" for r in shown)])


def lines(page: str) -> DataFrame:
    """(line, text) of a page."""
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame(list(enumerate(page.split("\n"), 1)), "line int, text string")


def compared(made: DataFrame, stored: DataFrame) -> DataFrame:
    """One row (lines, edited, same) of a page (line, text) that was written again and the stored one."""
    both = made.join(stored.select("line", F.col("text").alias("__was")), "line", "full")
    unlike = ~F.col("text").eqNullSafe(F.col("__was"))
    return both.agg(F.count(F.lit(1)).alias("lines"), F.count_if(unlike).alias("edited"), (F.count_if(unlike) == 0).alias("same"))
