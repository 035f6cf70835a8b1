"""Loads, runs, caches and pages that come over HTTP."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import history, load, report, serve
from ledgerfold.sources.http import PageSession, PageSource, SessionExpired
from ledgerfold.storage import unused
from ledgerfold.streaming import alerts, ingest


def test_first_load_then_lookback(spark):
    rows = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-09"), ("c", None), ("d", "2026-01-10")], "bidder_id string, last_award string")
    ids = lambda df: [r["bidder_id"] for r in df.collect()]
    taken, mark = load.bidder_load(rows, load.Watermark(), 5, "2026-02-01")
    assert ids(taken) == ["a", "b"] and (mark.bidders, mark.bidders_after) == ("", "b")
    taken, mark = load.bidder_load(rows, mark, 100, "2026-02-01")
    assert ids(taken) == ["c", "d"] and (mark.bidders, mark.bidders_after) == ("2026-01-10", "")
    late = rows.unionByName(spark.createDataFrame([("e", "2026-01-07"), ("f", "2026-01-06"), ("g", "2026-01-12")], rows.schema))
    taken, after = load.bidder_load(late, mark, 100, "2026-02-01")
    assert ids(taken) == ["g", "d", "b", "e"] and after.bidders == "2026-01-12"
    taken, after = load.bidder_load(late, mark, 4, "2026-02-01")
    assert ids(taken) == ["g", "d"] and after == mark
    assert load.bidder_load(late, mark, 0, "2026-02-01")[1] == mark
    assert load.bidder_load(rows.where("false"), load.Watermark(), 9, "2026-02-01")[1].bidders == "2026-02-01"


def test_the_mark_moves_only_when_the_marker_is_back():
    before, after = load.Watermark(day="1"), load.Watermark(day="2")
    ran: list[str] = []
    run = lambda s: ran.append(s) is None
    assert load.committed(["x"], "t1", run, lambda k: "t1", before, after) is after and load.MARKER in ran[-1]
    assert load.committed(["x"], "t1", run, lambda k: "t0", before, after) is before
    assert load.committed(["x"], "t1", run, lambda k: None, before, after) is before
    assert load.committed(["x"], "t1", lambda s: s != "x", lambda k: "t1", before, after, wait=lambda s: None) is before


def test_runs_are_recorded_also_if_they_fail(spark, tmp_path):
    log = str(tmp_path / "log")
    alerts.recorded(spark, log, "2026-01-01T00", lambda: {"candidates": 3, "sent": 1})
    with pytest.raises(KeyError):
        alerts.recorded(spark, log, "2026-01-01T01", lambda: {}["1234567"])
    alerts.recorded(spark, log, "2026-01-01T02", lambda: {}, dry=True)
    one = alerts.run_summary(spark.read.parquet(log)).first()
    assert (one["runs"], one["errored"], one["sent"], one["last_run"]) == (2, 1, 1, "2026-01-01T01") and one["last_error"] == "KeyError: '#'"
    with pytest.warns(UserWarning, match="not recorded"):
        (tmp_path / "file").write_text("")
        assert alerts.recorded(spark, str(tmp_path / "file" / "log"), "x", lambda: {"sent": 2}) == {"sent": 2}


def test_runs_of_one_load_look_once(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "b"), (6, "a"), (7, "")], "ran_at int, load string")
    assert [r["examined"] for r in alerts.due(runs).orderBy("ran_at").collect()] == [True, False, True, True, False, True, True]


def test_a_summary_is_computed_once_a_load(spark, tmp_path):
    made: list[int] = []

    def compute():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    one = lambda marker: serve.cached(spark, str(tmp_path), "stats", marker, compute).first()["n"]
    assert [one("l/1"), one("l/1"), one("l/2"), one("l/1"), one(""), one("")] == [1, 1, 2, 1, 3, 4]
    assert serve.cache_key(serve.Filters()) == "filters-Live" and serve.cache_key(serve.Filters(q="x")) is None and serve.cache_key(serve.Filters(status="Closed")) is None


def test_crawls_keep_to_their_time():
    now = iter(range(0, 1000, 10))
    out: list = []
    saved: list = []
    ended = ingest.crawl(lambda p: ([{"tender_id": str(p)}], 99), out.extend, None, seconds=35, clock=lambda: next(now), save=lambda p, t: saved.append(p))
    assert ended == "stopped" and [r["tender_id"] for r in out] == ["1", "2", "3"] and saved[-1] == 3


def test_collections_leave_stubs():
    pages = {"1": {"brief": "x"}, "2": None, "4": {"brief": "y"}}
    out: list = []
    assert ingest.collect(["1", "2", "3", "4"], lambda k: pages[k], out.extend, flush=2) == "done"
    assert [(r["tender_id"], r["missing"]) for r in out] == [("1", False), ("2", True), ("4", False)]
    assert ingest.collect([str(i) for i in range(9)], {}.__getitem__, out.extend) == "failed"
    assert ingest.collect(["1"], pages.get, out.extend, seconds=5, clock=iter([0, 9]).__next__) == "stopped"


class Portal(BaseHTTPRequestHandler):
    seen: list[str] = []

    def do_GET(self):  # noqa: N802
        Portal.seen.append(self.path)
        known = "s=1" in (self.headers.get("Cookie") or "")
        status = 404 if "page=3" in self.path else 200
        body = "" if status != 200 else "warm" if self.path == "/" else f"body of {self.path}" if known else "please sign in"
        self.send_response(status)
        if self.path == "/":
            self.send_header("Set-Cookie", "s=1")
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def portal():
    server = HTTPServer(("127.0.0.1", 0), Portal)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_over_http(spark, portal):
    spark.dataSource.register(PageSource)
    read = spark.read.format("pages").option("url", portal + "/list?page={page}").option("pages", 4).option("tasks", 2).option("per_second", 100).option("warm_up", portal + "/").option("expired", "please sign in")
    got = {r["page"]: (r["status"], r["body"]) for r in read.load().collect()}
    assert got[1] == ("ok", "body of /list?page=1") and got[4][0] == "ok" and got[3][0].startswith("PageError: 404") and len(got) == 4


def test_sessions_wait_and_expire(portal):
    waits: list[float] = []
    now = [0.0]
    session = PageSession(portal + "/", "please sign in", 2, waits.append, lambda: now[0])
    assert session.page(portal + "/list?page=1").startswith("body") and waits == [0.5]
    with pytest.raises(SessionExpired):
        PageSession("", "please sign in", 100, lambda s: None).page(portal + "/list?page=1")


def test_reports(spark):
    page = report.accuracy_page(spark.createDataFrame([("b_c", 0.5, 0.25), ("a", 1.0, 0.0)], "figure string, now double, spread double"))
    assert page.split("\n")[-2:] == ["| a | 1.0000 | 0.0000 |", "| b c | 0.5000 | 0.2500 |"]
    lines = report.lines(page)
    assert report.compared(lines, lines).first()["same"] is True
    assert report.compared(lines, lines.where("line < 6")).first().asDict() == {"lines": 6, "edited": 1, "same": False}


def test_pads_follow_drift_by_group(spark):
    rows = [("a", float(i % 10), 2.0, 7.0) for i in range(400)] + [("b", 1.0, 0.0, 2.0)] * 10
    cal = spark.createDataFrame(rows, "method string, y double, lo double, hi double")
    later = cal.withColumn("y", F.when(F.col("method") == "a", F.col("y") * 1.1).otherwise(F.col("y")))
    pads = {r["method"]: r["pad"] for r in history.drifted_pads(cal, later, least=300).collect()}
    assert set(pads) == {"a", None} and pads["a"] > 1.0
    inside = later.where("method = 'a'").select(F.avg((F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")) <= pads["a"]).cast("double"))).first()[0]
    assert inside >= 0.8


def test_unused_names():
    assert unused(["key", "KEY_"], "key") == "key__" and unused([], "key") == "key"
