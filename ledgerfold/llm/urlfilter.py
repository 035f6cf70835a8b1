"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

A rule fits its host and all subdomains where the url's path starts with the rule's path. Of the rules that fit, the one with most host
labels and then the longest path decides, be it allow or block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.native import LOWER, UPPER

#: Bytes of entries that the broadcast trie holds at most (some ten times as much in Python); with more, rules are joined by host.
TRIE_BYTES = 4 << 20

Rule = tuple[str, str, str]


def split_rule(entry: str) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of an entry like ``example.org/en/``."""
    host, slash, path = entry.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def trie(rules: Iterable[tuple[str, str]]) -> dict:
    """Nested dicts: reversed host labels, below ``None`` the path's segments, whose last is kept under ``""`` as it may be a part of one.

    ``rules``: (verdict, entry). Of entries for the same host and path the last counts.
    """
    root: dict = {}
    for verdict, entry in rules:
        host, path = split_rule(entry)
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault(("end",), {})[last] = (entry, verdict)
    return root


def longest(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """Entry and verdict of the rule that decides, or None."""
    node, found, segments = root, None, path.split("/")
    for label in reversed(host.split(".")):
        if (node := node.get(label)) is None:
            break
        at = node.get(None)
        for segment in segments:
            if at is None:
                break
            # The rest of a rule may be a part of this segment; the longest part wins.
            best = max((x for x in at.get(("end",), {}) if segment.startswith(x)), key=len, default=None)
            if best is not None:
                found = at[("end",)][best]
            at = at.get(segment)
    return found


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def _by_trie(root: dict, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[str, str], Any] = {}
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            got = [known[k] if k in known else known.setdefault(k, longest(root, *k)) for k in zip(hosts, paths, strict=True)]
            rule, verdict = pa.array([g and g[0] for g in got], pa.string()), pa.array([g[1] if g else default for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return run


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for any number of rules (verdict, entry): a url meets the rules of its host's suffixes."""
    host = F.translate(F.substring_index("entry", "/", 1), UPPER, LOWER)
    entry_path = F.when(F.instr("entry", "/") > 0, F.expr("substr(entry, instr(entry, '/'))")).otherwise("")
    last = F.max_by(F.struct("entry", "verdict"), _standing(F.col("entry"), F.col("verdict"), F.col("order"))).alias("last")
    held = rules.groupBy(host.alias("suffix"), entry_path.alias("entry_path")).agg(last).select("suffix", "entry_path", "last.entry", "last.verdict")
    pages = urls.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    met = pages.select("host", "path", F.explode(suffixes).alias("suffix")).join(held, "suffix").where(F.col("path").startswith(F.col("entry_path")))
    size = F.struct(F.size(F.split("suffix", "\\.")).alias("labels"), F.length("entry_path").alias("length"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("entry", "verdict"), size).alias("best"))
    return urls.join(best, ["host", "path"], "left").withColumn("rule", F.col("best.entry")).withColumn("verdict", F.coalesce("best.verdict", F.lit(default))).drop("best")


def _standing(entry: Column, verdict: Column, order: Column) -> Column:
    """Of rules for one host and path the one that is greatest by this counts."""
    return F.struct(order.cast("double"), verdict == "block", entry)


def judged(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of ``pages``: id, ``host``, ``path``, ``rule`` (the entry that decides, or null), ``verdict``.

    ``rules``: (verdict, entry) pairs, or a DataFrame with these columns and perhaps a number ``order``. Of rules for the same host and path
    the last of a list counts, of a DataFrame the one of the greatest ``order``; of equal ones block, then the greatest entry. Entries that
    are null count for nothing. Up to ``trie_bytes`` of them go to all executors as a trie, more are joined by host, with the same result.
    ``default`` is the verdict where no rule fits: null and empty urls, and those without ``://``, have an empty host
    and path, which none fits. Repeated rows are judged alike. Other columns of ``pages`` are not read.
    """
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        if sum(len(entry.encode()) for _, entry in rules) > trie_bytes:
            rules = pages.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, entry string, order long")
    if isinstance(rules, DataFrame):
        order = F.coalesce(F.col("order").cast("double"), F.lit(0.0)) if "order" in rules.columns else F.lit(0.0)
        rules = rules.where("entry is not null").select("verdict", "entry", order.alias("order"))
        if (rules.agg(F.sum(F.octet_length("entry"))).first()[0] or 0) > trie_bytes:
            return _by_join(urls, rules, default).select(id_col, "host", "path", "rule", "verdict")
        ordered = sorted(rules.collect(), key=lambda r: (r["order"], r["verdict"] == "block", r["entry"].encode()))
        rules = [(r["verdict"], r["entry"]) for r in ordered]
    id_type = urls.schema[id_col].dataType.simpleString()
    return urls.mapInArrow(_by_trie(trie(rules), default), f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
