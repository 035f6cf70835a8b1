from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.schemas import TENDERS
from ledgerfold.sources import lake
from ledgerfold.streaming import alerts, ingest

NOTICE = "tender_id string, title string, ministry string, status string, category string, fetched_at string"
FILTER = "array<struct<q:string,ministry:string,status:string,district:string,category:string>>"


def subs(spark, **filters):
    rows = [(k, [tuple(f.get(c, "") for c in ("q", "ministry", "status", "district", "category")) for f in v]) for k, v in filters.items()]
    return spark.createDataFrame(rows, f"sub_id string, filters {FILTER}")


def test_matching(spark):
    n = spark.createDataFrame([("1", "Dot Matrix Printer Ribbon", "Health", "Live", "it_hw", "t1")], NOTICE)
    s = subs(spark, hit=[{"q": "printer"}], wrong=[{"q": "printer", "ministry": "Roads"}], empty=[{}], none=[], district=[{"q": "printer", "district": "Dhaka"}], parent=[{"category": "it"}], other=[{"category": "it_sw"}], two=[{"q": "zzz"}, {"ministry": "Health"}])
    sent = spark.createDataFrame([("two", "1")], "sub_id string, tender_id string")
    got = {r["sub_id"] for r in alerts.matched(n, s, sent, {"it": ["it_hw", "it_sw"]}).collect()}
    assert got == {"hit", "parent"}


def test_cap_and_cursor(spark):
    n = spark.createDataFrame([(f"{i:02d}", "x", "M", "Live", "", "t1") for i in range(30)], NOTICE)
    s, none = subs(spark, a=[{"q": "X"}]), spark.createDataFrame([], "sub_id string, tender_id string")
    assert sorted(r["tender_id"] for r in alerts.matched(n, s, none).collect()) == [f"{i:02d}" for i in range(20)]
    assert [r["tender_id"] for r in alerts.candidates(n, "t1", "27").collect()] == ["28", "29"]


def test_equal_filters_meet_the_notices_once(spark):
    n = spark.createDataFrame([(f"{i:03d}", f"x{i % 9} y{i % 4}", f"M{i % 3}", "Live", "", f"t{i // 40}") for i in range(300)], NOTICE)
    n = n.unionByName(n.where("tender_id < '005'").withColumn("fetched_at", F.lit("t9")))
    kinds = [[{"q": "x1"}], [{"q": "X2"}, {"ministry": "M1"}], [{"q": "y3", "ministry": "M0"}, {"q": "nothing"}], [{"q": "nothing"}], [{"status": "Live"}]]
    s = subs(spark, **{f"s{i}": kinds[i % 5] for i in range(40)})
    sent = s.crossJoin(n.select("tender_id")).where(F.pmod(F.hash("sub_id", "tender_id"), F.lit(3)) == 0).select("sub_id", "tender_id")
    sent = sent.unionByName(sent.limit(50)).unionByName(spark.createDataFrame([("s1", "gone"), (None, "003")], sent.schema))
    for per in (1, 20, 500):
        got = alerts.matched(n, s, sent, per=per)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alerts.to_send(alerts.met(n, s), sent, per).collect())) != []
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()  # no pairs of subscriptions and notices


def test_stream_sends_once(spark, tmp_path):
    kinds = spark.createDataFrame([], NOTICE).schema
    s = subs(spark, a=[{"q": "road"}])
    for i, rows in enumerate([[("1", "Road A", "M", "Live", "", "t1"), ("2", "Bridge", "M", "Live", "", "t1")], [("1", "Road A", "M", "Live", "", "t2"), ("3", "Road B", "M", "Live", "", "t2")]]):
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(str(tmp_path / "in"))
        alerts.stream(ingest.files(spark, str(tmp_path / "in"), kinds), s, str(tmp_path / "out")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/messages")).count() == i + 1


def test_deltas_keep_unseen_rows_only(spark, tmp_path):
    root = str(tmp_path)
    for ids in (["1", "2"], ["2", "3"]):
        lake.conformed(spark.createDataFrame([(i, "Live") for i in ids], "tender_id string, status string"), TENDERS).write.mode("append").parquet(f"{root}/in")
        ingest.deltas(ingest.files(spark, f"{root}/in", TENDERS), root, "tenders").awaitTermination()
    assert sorted(r["tender_id"] for r in lake.parts(spark, root, "tenders").collect()) == ["1", "2", "3"]


def test_crawl_policy():
    pages = {1: [{"tender_id": "9"}, {"tender_id": "8"}], 2: [{"tender_id": "7"}, {"tender_id": "6"}], 3: [{"tender_id": "5"}]}
    got: list = []
    assert ingest.crawl(lambda p: (pages.get(p, []), 3), got.extend, lambda ids: {"7", "6", "5"} & set(ids)) == "done"
    assert [r["tender_id"] for r in got] == ["9", "8"]

    def broken(p: int):
        raise OSError

    assert ingest.crawl(broken, got.extend, None) == "failed"
    assert ingest.crawl(lambda p: (pages.get(p, []), 3), got.extend, None, most=2) == "stopped"


def test_rate_limit(spark):
    rows = [("h", f"2026-01-01 00:{m:02d}:00", m) for m in (0, 1, 2)] + [("h", "2026-01-01 01:00:30", 9)]
    df = spark.createDataFrame(rows, "hash string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["id"]: r["allowed"] for r in alerts.rate_limited(df, 2).collect()} == {0: True, 1: True, 2: False, 9: False}
