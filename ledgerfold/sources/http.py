"""Pages over HTTP: a polite session, and a Spark data source that reads a range of pages with it.

``spark.dataSource.register(PageSource)``, then ``spark.read.format("pages").option("url", "https://host/list?page={page}")
.option("pages", 200).option("tasks", 4).load()`` gives (page, status, body). Each task has a session of its own, so ``tasks`` times
``per_second`` requests reach the host a second.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from http.cookiejar import CookieJar

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PER_SECOND, TIMEOUT_S = 1.0, 60.0


class PageError(Exception):
    """A page that came with another status than 200."""


class SessionExpired(PageError):
    """The host answered with the page it shows to those without a session."""


class PageSession:
    """Requests with cookies, at most ``per_second`` of them; ``warm_up`` is visited once before the first page and after an expiry."""

    def __init__(self, warm_up: str = "", expired: str = "", per_second: float = PER_SECOND, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.warm_up, self.expired, self.gap, self.wait, self.clock = warm_up, expired, 1 / per_second, wait, clock
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(CookieJar()))
        self.last: float | None = None
        self.warm = not warm_up

    def _get(self, url: str) -> tuple[int, str]:
        if self.last is not None and (left := self.gap - (self.clock() - self.last)) > 0:
            self.wait(left)
        self.last = self.clock()
        try:
            with self.opener.open(url, timeout=TIMEOUT_S) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""

    def page(self, url: str) -> str:
        """The body of a page; an expired session is opened again once."""
        for again in (True, False):
            if not self.warm:
                self._get(self.warm_up)
                self.warm = True
            status, body = self._get(url)
            if status != 200:
                raise PageError(f"{status} for {url}")
            if not self.expired or self.expired not in body:
                return body
            self.warm = not (again and self.warm_up)
        raise SessionExpired(url)


class _Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[_Pages]:
        first, n, tasks = int(self.options.get("first", 1)), int(self.options.get("pages", 1)), max(1, int(self.options.get("tasks", 1)))
        cuts = [first + n * i // tasks for i in range(tasks + 1)]
        return [_Pages(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        o = self.options
        session = PageSession(o.get("warm_up", ""), o.get("expired", ""), float(o.get("per_second", PER_SECOND)))
        for page in range(partition.first, partition.last):
            try:
                yield page, "ok", session.page(o["url"].replace("{page}", str(page)))
            except (PageError, OSError) as e:
                yield page, f"{type(e).__name__}: {e}"[:200], None


class PageSource(DataSource):
    """Options: ``url`` with ``{page}``, ``first``, ``pages``, ``tasks``, ``per_second``, ``warm_up``, ``expired`` (a text that only the page for expired sessions has)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, status string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
