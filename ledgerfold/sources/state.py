"""State that outlives a run: crawl checkpoints, load watermarks, and a lock that goes stale."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

STALE_S = 6 * 3600


@dataclass
class Checkpoint:
    endpoint: str
    next_page: int = 1
    total_pages: int = 0
    backfill_done: bool = False

    def seen(self, page: int, total: int) -> None:
        """A finished backfill stays finished."""
        self.next_page, self.total_pages = page + 1, max(total, self.total_pages)
        self.backfill_done = self.backfill_done or (total > 0 and page >= total)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read(path: str, spark: SparkSession | None) -> str | None:
    if spark is None:
        return Path(path).read_text(encoding="utf-8") if Path(path).exists() else None
    fs, at = _fs(spark, path)
    return spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8") if fs.exists(at) else None


def load_state(path: str, kind: type, spark: SparkSession | None = None, **defaults: Any):
    """A dataclass from JSON: unknown fields are ignored, missing ones have their defaults, another endpoint's state is an error.

    ``spark``: the path is in any store that Spark reaches, else a local file.
    """
    found = json.loads(_read(path, spark) or "{}")
    if "endpoint" in defaults and found.get("endpoint", defaults["endpoint"]) != defaults["endpoint"]:
        raise ValueError(f"{path} is of {found['endpoint']}")
    known = {f.name for f in fields(kind)}
    return kind(**(defaults | {k: v for k, v in found.items() if k in known}))


def save_state(path: str, state: Any, spark: SparkSession | None = None) -> None:
    """Written beside, then renamed over the old one."""
    text = json.dumps(asdict(state), indent=1)
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(f"{path}.new").write_text(text, encoding="utf-8")
        os.replace(f"{path}.new", path)
        return
    fs, at = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} could not be replaced")


class Lock:
    """Exclusive by creation of a file, in a store that all runs share if ``spark`` is given; one older than six hours is taken over."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self.spark = path, spark

    def __enter__(self) -> Lock:
        if self.spark is None:
            at = Path(self.path)
            at.parent.mkdir(parents=True, exist_ok=True)
            if at.exists() and time.time() - at.stat().st_mtime > STALE_S:
                at.unlink()
            os.close(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return self
        fs, at = _fs(self.spark, self.path)
        if fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > STALE_S:
            fs.delete(at, False)
        if not fs.createNewFile(at):
            raise FileExistsError(self.path)
        return self

    def __exit__(self, *_: object) -> None:
        if self.spark is None:
            Path(self.path).unlink(missing_ok=True)
        else:
            fs, at = _fs(self.spark, self.path)
            fs.delete(at, False)
