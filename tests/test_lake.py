from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerfold.schemas import PREDICTIONS
from ledgerfold.sources import lake
from ledgerfold.sources.state import Checkpoint, Lock, load_state, save_state


def test_latest_row_of_each_key(spark, tmp_path):
    root = str(tmp_path)
    lake.append(spark.createDataFrame([("1", "Live"), ("2", "Live")], "tender_id string, status string"), root, "tenders", "20260101T000000000000Z")
    lake.append(spark.createDataFrame([("1", "Cancelled")], "tender_id string, status string"), root, "tenders", "20260102T000000000000Z")
    got = {r["tender_id"]: r["status"] for r in lake.load_all(spark, root, "tenders").collect()}
    assert got == {"1": "Cancelled", "2": "Live"}


def test_ids_of_several_types_and_a_corrupt_part(spark, tmp_path):
    root = str(tmp_path)
    lake.append(spark.createDataFrame([(1,)], "tender_id long"), root, "tenders")
    lake.append(spark.createDataFrame([("2",)], "tender_id string"), root, "tenders")
    Path(root, "raw/tenders/part-zero.parquet").write_bytes(b"")
    Path(root, "raw/tenders/part-bad.parquet").write_bytes(b"not parquet at all")
    assert {r[0] for r in lake.known_ids(spark, root, "tenders").collect()} == {"1", "2"}


def test_missing_endpoint_is_empty(spark, tmp_path):
    assert lake.load_all(spark, str(tmp_path), "contracts").count() == 0
    assert lake.read_clean(spark, str(tmp_path), "predictions", PREDICTIONS).columns == PREDICTIONS.fieldNames()


def test_compaction_keeps_the_latest_and_drops_loose_parts(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        lake.append(spark.createDataFrame([("1", str(i)), (f"n{i}", "x")], "tender_id string, status string").coalesce(1), root, "tenders", f"2026010{i + 1}T000000000000Z")
    assert not lake.compact(spark, root, "tenders", min_parts=20)
    assert lake.compact(spark, root, "tenders", min_parts=4)
    names = [p.name for p in Path(root, "raw/tenders").glob("*.parquet")]
    assert len(names) == 1 and names[0].startswith("compact-")
    got = {r["tender_id"]: r["status"] for r in lake.load_all(spark, root, "tenders").collect()}
    assert got == {"1": "3", "n0": "x", "n1": "x", "n2": "x", "n3": "x"}


def test_compaction_leaves_what_it_cannot_read(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        lake.append(spark.createDataFrame([(f"n{i}", "x")], "tender_id string, status string").coalesce(1), root, "tenders")
    lake.append(spark.createDataFrame([(7,)], "tender_id long").coalesce(1), root, "tenders")
    bad = Path(root, "raw/tenders/part-bad.parquet")
    bad.write_bytes(b"not parquet at all, but it may be mended")
    with pytest.warns(UserWarning, match="part-bad"):
        assert lake.compact(spark, root, "tenders", min_parts=4)
    assert bad.exists() and not list(Path(root, "raw/tenders").glob("part-0*.parquet"))
    assert {r[0] for r in lake.known_ids(spark, root, "tenders").collect()} == {"n0", "n1", "n2", "7"}


def test_clean_tables_are_replaced(spark, tmp_path):
    for v in (1.0, 2.0):
        lake.write_clean(spark.createDataFrame([("1", v)], "tender_id string, q50_lakh double"), str(tmp_path), "predictions")
    assert [r["q50_lakh"] for r in lake.read_clean(spark, str(tmp_path), "predictions", PREDICTIONS).collect()] == [2.0]


def test_union_of_unlike_frames(spark):
    a, b = spark.range(1).select(F.col("id").alias("k"), F.lit(1).alias("x")), spark.createDataFrame([("z",)], "k string")
    assert sorted(lake.union_relaxed([a, b]).collect(), key=str) == [("0", 1), ("z", None)]


def test_state_and_lock(tmp_path):
    path = str(tmp_path / "s.json")
    c = Checkpoint("tenders")
    c.seen(3, 3)
    save_state(path, c)
    again = load_state(path, Checkpoint, endpoint="tenders")
    assert again.next_page == 4 and again.backfill_done
    again.seen(4, 9)
    assert again.backfill_done
    try:
        load_state(path, Checkpoint, endpoint="contracts")
        raise AssertionError
    except ValueError:
        pass
    with Lock(str(tmp_path / "l")):
        try:
            with Lock(str(tmp_path / "l")):
                raise AssertionError
        except FileExistsError:
            pass


def test_state_and_lock_in_a_shared_store(spark, tmp_path):
    path = f"file://{tmp_path}/deep/s.json"
    assert load_state(path, Checkpoint, spark, endpoint="tenders").next_page == 1
    for page in (3, 4):
        c = Checkpoint("tenders")
        c.seen(page, 9)
        save_state(path, c, spark)
    assert load_state(path, Checkpoint, spark, endpoint="tenders").next_page == 5
    lock = f"file://{tmp_path}/lock"
    with Lock(lock, spark), pytest.raises(FileExistsError), Lock(lock, spark):
        pass
    with Lock(lock, spark):
        pass
