from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from ledgerfold.functions import taxonomy
from ledgerfold.operators import bands, classify, evaluate, labels, load, profiles, quality, ranks, resolve, serve
from ledgerfold.storage import saved


def awards(spark):
    rows = [(str(i), "p1", "A", "A Ltd", "2026-09-01", 0.1) for i in range(8)] + [("8", "p1", "B", "B", "2026-09-01", 0.1), ("9", "p1", "C", "C", "2026-09-01", 0.1), ("10", "p2", "A", "A Ltd", "2026-09-02", 9.0), ("11", "p1", "", "", "2026-09-02", 1.0), ("12", "p1", "A", "A Ltd", None, 1.0)]
    return spark.createDataFrame(rows, "tender_id string, pe_id string, bidder_id string, awardee string, signed_on string, value_crore double")


def test_concentration(spark):
    got = {r["pe_id"]: r for r in profiles.concentration(awards(spark), "2025-09-13").collect()}
    p1 = got["p1"]
    assert (p1["awards_12m"], p1["winners"], p1["top_share"], p1["top3_share"], p1["hhi"], p1["top_bidder"]) == (10, 3, 0.8, 1.0, 0.66, "A Ltd")
    assert p1["notes"][0] == "One bidder won 80 percent of 10 awards in the last 12 months" and "HHI 0.66" in p1["notes"][1]
    assert got["p2"]["notes"] == []


def test_dependence(spark):
    bands_ = spark.createDataFrame([("0", 100.0, 200.0), ("10", 1.0, 2.0)], "tender_id string, q10_lakh double, q90_lakh double")
    got = {r["bidder_id"]: r for r in profiles.dependence(awards(spark), bands_, "2025-09-13").collect()}
    a = got["A"]
    assert (a["awards_12m"], a["entities"], a["top_entity"], a["top_entity_share"], a["above_band"], a["below_band"]) == (9, 2, "p1", 0.8889, 1, 1)
    assert got["B"]["above_band"] == 0 and "" not in got
    assert profiles.dependence(awards(spark).where("false"), bands_, "2025").count() == 0


def test_recent_awards_and_stats(spark):
    r = profiles.recent_awards(awards(spark), "bidder_id", ["tender_id", "signed_on"], 2, ["tender_id"]).where("bidder_id = 'A'").first()
    assert json.loads(r["recent_awards"]) == [{"tender_id": "10", "signed_on": "2026-09-02"}, {"tender_id": "0", "signed_on": "2026-09-01"}]
    s = {r["bidder_id"]: r for r in profiles.bidder_stats(awards(spark)).collect()}
    assert s["A"]["n_awards"] == 10 and s["A"]["last_award"] == "2026-09-02"


def test_finite_sample_quantiles(spark):
    values = [math.sin(i * 12.9898) for i in range(57)]
    r = bands.banded(spark.createDataFrame([("m", v) for v in values], "method string, r double"), ["method"], "r").first()
    import numpy as np

    n = len(values)
    assert abs(r["lo"] - np.quantile(values, 0.1 * (n + 1) / n)) < 1e-12 and abs(r["hi"] - np.quantile(values, 0.9 * (n + 1) / n)) < 1e-12 and abs(r["centre"] - np.median(values)) < 1e-12


def test_security_route(spark):
    rows = [("p1", "OTM", f"2026-01-{i % 28 + 1:02d}", str(i), 36.0 + i % 5, 1.0) for i in range(60)] + [("p2", "LTM", "2026-01-01", "x", 50.0, 1.0), ("p2", "LTM", "2026-01-02", "typo", 1.0, 80_000.0)]
    df = spark.createDataFrame(rows, "pe_id string, method string, signed_on string, tender_id string, lakh double, security_lakh double")
    overall, by_method, by_entity = bands.security_fit(df)
    assert overall.first()["n"] == 61 and [r["method"] for r in by_method.collect()] == ["OTM"]
    p2 = {r["pe_id"]: r["by_entity"] for r in by_entity.collect()}["p2"]
    assert abs(p2 - (math.log(50) + 10 * math.log(38)) / 11) < 1e-9
    out = bands.security_multiple(spark.createDataFrame([("p9", "OTM"), ("p9", "zzz"), ("p2", "OTM")], "pe_id string, method string"), (overall, by_method, by_entity))
    assert out.where("multiple is null").count() == 0


def test_quantiles_of_rows_in_several_groups(spark):
    import numpy as np

    odd = [0.0, -0.0, 1e300, -1e300, 5e-324, math.inf]
    rows = [("a", 1, math.sin(i) * 10 ** (i % 9 - 4)) for i in range(400)] + [("a", 2, 3.0)] * 50 + [("b", 1, 2.0 + i * 1e-12) for i in range(300)] + [(None, 1, v) for v in odd] + [("c", 1, 7.0), ("c", 3, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    level = {"mid": F.lit(0.5), "low": F.greatest(F.lit(0.0), 0.1 * (F.col("__n") + 1) / F.col("__n")), "top": F.lit(1.0)}
    want = lambda v: (len(v), *np.quantile(v, [0.5, 0.1 * (len(v) + 1) / len(v), 1.0]))
    same = lambda got, v: np.testing.assert_allclose([got["n"], got["mid"], got["low"]], want(v)[:3], rtol=1e-12)
    plain = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", level).collect()}
    assert plain["c"]["n"] == 1 and plain["c"]["low"] == 7.0 and plain[None]["top"] == math.inf and len(plain) == 4
    for g in ("a", "b"):
        same(plain[g], [v for x, _, v in rows if x == g])
    twice = lambda d: d.withColumn("of", F.explode(F.sequence(F.col("k"), F.lit(2)))).drop("k").where("of <= 2")
    got = {r["of"]: r for r in ranks.quantiles(df.where("g is not null"), ["of"], "v", level, keys=["k"], spread=twice).collect() if r["of"] in (1, 2)}
    same(got[1], [v for g, k, v in rows if g and k == 1 and v is not None])
    same(got[2], [v for g, k, v in rows if g and k <= 2 and v is not None])


def _signed(spark, n=900):
    rows = [(str(i), f"2026-{i % 6 + 1:02d}-{i * 7 % 28 + 1:02d}", f"p{i % 4}" if i % 50 else None, "ABC"[i % 3] if i % 41 else "", 20.0 + i * 37 % 101, 1.0 + i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "tender_id string, signed_on string, pe_id string, method string, lakh double, security_lakh double")


def test_weekly_misses_read_earlier_rows_once(spark):
    """Against the plain form: all earlier rows joined to each week."""
    import datetime

    import numpy as np

    rows = _signed(spark)
    got = bands.weekly_misses(rows, 7)
    assert "percentile(" not in got._jdf.queryExecution().toString()  # which holds all values of a group in one task
    data = [(*r, math.log(r["lakh"] / r["security_lakh"])) for r in rows.collect()]
    monday = lambda day: (d := datetime.date.fromisoformat(day)) - datetime.timedelta(d.weekday())
    every = [monday(r[1]) for r in data]
    weeks = sorted(w for w in sorted(set(every))[-7:] if every.count(w) >= bands.WEEK_ROWS)
    first = {p: min((r[1], r[0], r[3]) for r in data if r[2] == p)[2] for p in {r[2] for r in data}}
    want = []
    for place, week in enumerate(weeks, 1):
        seen = [r for r in data if monday(r[1]) < week]
        overall = np.median([r[6] for r in seen])
        method = {m: np.median(v) for m in "ABC" if len(v := [r[6] for r in seen if r[3] == m]) >= bands.METHOD_ROWS}
        for r in (r for r in data if monday(r[1]) == week):
            own = [x[6] for x in seen if r[2] and x[2] == r[2]]
            back = method.get(first[r[2]], overall)
            price = (np.median(own) * len(own) + back * 10) / (len(own) + 10) if own else method.get(r[3], overall)
            want.append((week, place, round(r[6] - price, 9)))
    assert sorted((r["week"], r["place"], round(r["miss"], 9)) for r in got.collect()) == sorted(want) != []
    assert bands.weekly_misses(rows.where("false"), 7).count() == 0


def test_halves_rank_one_day_only(spark):
    order = ["day", "id"]
    for n, days in ((0, 1), (1, 1), (7, 1), (40, 3), (41, 9), (60, 60)):
        rows = [(None if i % 11 == 5 else f"d{i * 13 % days:02d}", i * 29 % 61) for i in range(n)]
        df = saved(spark.createDataFrame(rows, "day string, id int"), "rows")
        early, late = (sorted(map(tuple, x.select(*order).collect()), key=lambda r: (r[0] or "", r[1])) for x in bands.halves(df, order))
        assert early + late == sorted(rows, key=lambda r: (r[0] or "", r[1])) and len(early) == n // 2


def test_security_fit_holds_no_group_in_one_task(spark):
    rows = _signed(spark)
    overall, by_method, by_entity = bands.security_fit(rows)
    for df in (overall, by_method, by_entity):
        assert "percentile(" not in df._jdf.queryExecution().toString()
    want = rows.select(F.percentile(F.log(F.col("lakh") / F.col("security_lakh")), 0.5)).first()[0]
    assert abs(overall.first()["overall"] - want) < 1e-12 and by_entity.count() == 4 and by_method.count() == 3


def test_routing_and_deferral(spark):
    t = spark.createDataFrame([("1",), ("2",), ("3",)], "tender_id string")
    route = lambda ids, q: spark.createDataFrame([(i, q / 2, q, q * 2) for i in ids], "tender_id string, q10 double, q50 double, q90 double")
    got = {r["tender_id"]: (r["basis"], r["q50"]) for r in bands.routed(t, route("12", 10.0), route("1", 20.0), route("123", 5.0)).collect()}
    assert got == {"1": ("plan", 20.0), "2": ("security", 10.0), "3": ("history", 5.0)}
    d = spark.createDataFrame([(1.0, 13.0, 5, "x", "history"), (1.0, 5.0, 2, "", "history"), (1.0, 5.0, 2, "c", "history"), (1.0, 99.0, 0, "", "security")], "a double, b double, h int, c string, s string")
    assert [r[0] for r in d.select(bands.deferred(*(F.col(c) for c in "abhcs"))).collect()] == [True, True, False, False]
    assert bands.plan_gate(10, 0.1, 0.8, 0.2)[0] is False and bands.plan_gate(300, 0.05, 0.8, 0.07)[0] and not bands.plan_gate(300, 0.05, 0.9, 0.07)[0]


def test_code_vote(spark):
    prefixes = spark.createDataFrame([("4521", "buildings"), ("4523", "roads"), ("3", "goods"), ("18", "textiles"), ("185", "silent")], "prefix string, category string")
    divisions = spark.createDataFrame([("45", 5, "construction"), ("18", 9, None), ("50", 9, "construction"), ("51", 9, "it")], "division string, groups long, sector string")
    sectors = spark.createDataFrame([("buildings", "construction"), ("roads", "construction"), ("textiles", "textiles")], "category string, sector string")
    tags = [("one", "45210000"), ("tie", "45210000"), ("tie", "45230000"), ("bare", "45110000"), ("silent", "18510000"), ("cloth", "18100000"), ("whole", "45110000"), ("whole", "45210000"), ("whole", "45230000")]
    got = {r["tender_id"]: (r["sector"], r["category"]) for r in labels.code_vote(spark.createDataFrame(tags, "tender_id string, code string"), prefixes, divisions, sectors).collect()}
    assert got == {"one": ("construction", "buildings"), "tie": ("construction", None), "bare": ("construction", None), "silent": (None, None), "cloth": ("textiles", "textiles"), "whole": ("construction", None)}


def test_taxonomy(spark):
    codes = spark.createDataFrame([(f"45{i}10000", f"Work {i}") for i in range(1, 7)] + [("18100000", "Occupational clothing"), ("39110000", "Seats, chairs; and parts"), ("45233140", "Roadworks.")], "code string, label string")
    tags = spark.createDataFrame([("a", "Seats,  chairs"), ("b", "roadworks"), ("c", "Computer hardware"), ("d", "Manufactured goods, furniture, handicrafts and more"), ("d", "seats, chairs"), ("e", "nonsense"), ("f", "Occupational clothing")], "tender_id string, tag string")
    found = labels.tag_codes(tags, codes, taxonomy.WORDINGS, taxonomy.OLD_PICKS)
    got = {r["tender_id"]: (r["sector"], r["category"]) for r in labels.code_vote(found, taxonomy.prefixes(spark), taxonomy.divisions(spark, codes), taxonomy.sectors(spark)).collect()}
    assert got == {"a": ("furniture", "furniture"), "b": ("construction", "roads_bridges"), "c": ("it_equipment", "it_equipment"), "f": ("textiles_uniforms", "textiles_uniforms")}
    label, margin = labels.keyword_label(F.lit("Supply of office chair and a table with computer"), taxonomy.IN_TITLES)
    assert tuple(spark.range(1).select(label, margin).first()) == ("furniture", 1)


def test_resolution(spark):
    counts = spark.createDataFrame([("M/S. Sawda Traders", 5), ("Sawda Traders", 3), ("SAWDA TRADERS.", 1), ("Rahim Enterprise", 2), ("Karim Brothers", 4), ("", 9)], "name string, n_rows long")
    named, entities, _ = resolve.resolve(counts)
    assert {(r["canonical_name"], r["n_rows"]) for r in entities.collect()} == {("M/S. Sawda Traders", 9), ("Rahim Enterprise", 2), ("Karim Brothers", 4)}
    ids = {r["name"]: r["entity_id"] for r in named.collect()}
    assert ids["Sawda Traders"] == ids["SAWDA TRADERS."] != "" and ids[""] == "" and len(ids["Karim Brothers"]) == 12


def test_decisions_override_scores(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.7), ("b", "c", 0.95)], "a string, b string, score double")
    decided = spark.createDataFrame([("a", "b", "keep"), ("a", "c", "merge")], "a string, b string, decision string")
    assert {(r["a"], r["b"]): r["verdict"] for r in resolve.split_pairs(pairs, decided).collect()} == {("a", "b"): "keep", ("a", "c"): "merge", ("b", "c"): "merge"}


def test_budget_is_spent_in_order(spark):
    queue = spark.createDataFrame([("live", 1, 8, "t1", "a"), ("live", 1, 8, "t1", "b"), ("live", 1, 8, "t2", "c"), ("bands", 2, 1, None, "x"), ("back", 5, 8, "t0", "z")], "part string, priority int, weight int, at string, key string")
    got = {r["key"]: (r["cost"], r["taken"]) for r in load.planned(queue, 25).collect()}
    assert got == {"a": (8, True), "b": (16, True), "c": (24, True), "x": (25, True), "z": (33, False)}
    plan = load.planned(queue.withColumn("part", F.when(F.col("part") == "live", "tenders_live").otherwise(F.col("part"))), 16)
    mark = load.advanced(load.Watermark(), plan, "2026-09-13")
    assert mark.live == load.Cursor("t1", "b") and mark.writes_today == 16
    assert load.left_today(mark, "2026-09-13", 20) == 4 and load.left_today(mark, "2026-09-14", 20) == 20
    rest = load.after(queue.where("part = 'live'").withColumnsRenamed({"at": "fetched_at", "key": "tender_id"}), mark.live)
    assert [r["tender_id"] for r in rest.collect()] == ["c"]


def test_statements_have_bounds(spark):
    df = spark.createDataFrame([(i, "it's", None if i % 2 else 1.5) for i in range(450)], "k long, s string, v double")
    rows = load.statements(df.coalesce(1), "t", ["k"], rows=200, size=2_000).collect()
    assert all(len(r["statement"].encode()) <= 2_000 + 2 for r in rows) and sum(r["statement"].count("(") - 1 for r in rows) == 450
    assert "'it''s', NULL" in rows[0]["statement"] + rows[1]["statement"]


def test_upserts(spark):
    table = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k long, v string, created string")
    rows = spark.createDataFrame([(2, "B", "new"), (3, "C", "new")], "k long, v string, created string")
    assert sorted(map(tuple, load.upserted(table, rows, ["k"], ["created"]).collect())) == [(1, "a", "old"), (2, "B", "old"), (3, "C", "new")]
    assert sorted(map(tuple, load.inserted(table, rows, ["k"]).collect())) == [(1, "a", "old"), (2, "b", "old"), (3, "C", "new")]
    tries = []
    assert load.executed(["a", "b", "c"], lambda s: tries.append(s) or s != "b", wait=lambda _: None) == 1 and tries == ["a", "b", "b", "b"]


def test_gate_and_noise(spark):
    f = lambda **kv: spark.createDataFrame(list(kv.items()), "figure string, value double")
    noise = spark.createDataFrame([("acc", "up", "share", 0.001, 0.004), ("err", "down", "share", None, None), ("width", "down", "multiple", None, None)], "figure string, better string, kind string, typical_step double, spread double")
    bad = quality.breaches(f(acc=0.93, err=0.10, width=3.0), f(acc=0.925, err=0.115, width=3.4), noise).collect()
    assert [(r["figure"], r["tolerated"]) for r in bad] == [("acc", 0.004)]
    runs = spark.createDataFrame([("x", i, v) for i, v in enumerate([1.0, 1.2, 1.1, 1.5])] + [("y", 0, 1.0), ("y", 1, 2.0)], "figure string, run int, value double")
    r = evaluate.run_noise(runs).collect()
    assert len(r) == 1 and (r[0]["typical_step"], r[0]["largest_step"], r[0]["net_change"], r[0]["spread"]) == (0.2, 0.4, 0.5, 0.5)


def test_curves(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.5, False)], "conf double, correct boolean")
    curve = evaluate.curve_by_confidence(rows)
    got = {r["target"]: (r["threshold"], r["deferral"]) for r in evaluate.deferral_for(curve, (0.75, 0.95, 1.1)).collect()}
    assert got == {0.75: (0.6, 0.2), 0.95: (0.8, 0.6), 1.1: (None, None)}
    assert classify.bar(curve, 1.1) == classify.FALLBACK
    assert {r["wrong_answer_costs"]: r["deferral"] for r in evaluate.cost_points(curve, (1, 10)).collect()}[10] == 0.6


def test_filters(spark):
    assert serve.Filters.of({"page": "0", "size": "999", "status": "all"}) == serve.Filters(status="all", page=1, size=100)
    df = spark.createDataFrame([("1", "100% wool", "Live", "child", "2026"), ("2", "100 wool", "Live", "parent", None), ("3", "x", "Closed", "child", "2025")], "tender_id string, title string, status string, category string, published_at string").withColumn("ministry", F.lit("M")).withColumn("method", F.lit(""))
    ids = lambda **kv: [r["tender_id"] for r in serve.listed(df, serve.Filters.of(kv), {"parent": ["child"]}).collect()]
    assert ids() == ["1", "2"] and ids(q="100% W") == ["1"] and ids(category="parent", status="all") == ["1", "3", "2"] and ids(category="child") == ["1"]
    assert serve.request_faults is not None


def test_bootstrap_brackets_the_coverage(spark):
    rows = spark.range(2000).select(F.col("id"), F.lit(1.0).alias("value"), F.when(F.col("id") % 5 == 0, 2.0).otherwise(0.5).alias("q10"), F.lit(3.0).alias("q90"))
    r = evaluate.bootstrap_coverage(rows, 100).first()
    assert 0.77 < r["lo"] < 0.8 < r["hi"] < 0.83
