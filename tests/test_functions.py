from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import names as N
from ledgerfold.functions import scalars as S
from ledgerfold.sources import html


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_numbers(spark):
    for text, value in (("2,433.5", 2433.5), ("0.137", 0.137), ("abc", None), ("1.2.3", None), ("", None)):
        assert one(spark, S.parse_number(F.col("t")), t=text) == value
    assert one(spark, S.parse_int(F.col("t")), t="Tk 1,200/-") == 1200


def test_dates(spark):
    assert one(spark, S.parse_datetime(F.col("t")), t="closes 13-Sep-2026 11:00 x") == "2026-09-13T11:00"
    assert one(spark, S.parse_datetime(F.col("t")), t="soon") is None
    assert one(spark, S.parse_day(F.col("t")), t="31-Feb-2026") is None


def test_names(spark):
    for raw, norm in (("M/S. Sawda Traders", "sawda traders"), ("Messrs. SAWDA   TRADERS", "sawda traders"), ("Rahim & Sons Enterprise", "rahim and sons enterprise"), ("ＡＢＣ Ltd", "abc ltd"), ("মেসার্স রহিম", "মেসার্স রহিম")):
        assert one(spark, N.normalize_name(F.col("t")), t=raw) == norm
    for norm, key in (("z s technologies ltd", "technologies"), ("ab", "ab"), ("", "")):
        assert one(spark, N.block_key(F.col("t")), t=norm) == key


def test_pair_rules(spark):
    for a, b, want in (
        ("sawda traders", "traders sawda", "merge"), ("a b khan", "ab khan", "merge"), ("khan traders", "khan store", "keep"), ("khan 1", "khan 2", "keep"),
        ("m k khan", "m s khan", "keep"), ("khan", "khan steel", ""), ("khan constr", "khan construction", ""), ("ltd", "khan", ""),
    ):
        assert one(spark, N.pair_decision(F.col("a"), F.col("b")), a=a, b=b) == want, (a, b)


def test_notification_and_display(spark):
    got = one(spark, S.notification(F.col("t"), F.col("e"), F.col("m"), F.col("c"), F.col("i")), t="x" * 90, e="", m="Roads", c="2026-09-03T11:00", i="7")
    assert got["heading"] == "x" * 79 + "…" and got["body"] == "Roads, closes 3 Sep" and got["url"] == "/tenders/7"
    assert one(spark, S.masked_error(F.lit("id 1234567 failed"))) == "id # failed"
    assert one(spark, S.slug(F.lit(" Roads & Bridges! "))) == "roads_bridges"


def test_list_page(spark):
    page = """<input type="hidden" id="totalPages" value="7"><table><tr><td>1</td><td>900,<br>REF 1,<br>Live</td>
    <td><input type="hidden" name="id" value="901">Goods,<br>Supply of &amp; chairs</td><td>Ministry A,<br>Org B,<br>PE C</td><td>NCT,<br>OTM</td><td>13-Sep-2026 11:00,<br>20-Sep-2026 12:00</td></tr>
    <tr><td>x</td><td></td><td></td><td></td><td></td><td></td></tr>
    <tr><td>2</td><td>902<br>R2<br>Amendment issued: 1</td><td>Works<br>Road</td><td>M<br>P</td><td>NCT</td><td></td></tr></table>"""
    a, b = html.tender_rows(spark.createDataFrame([(page,)], "html string")).orderBy("tender_id").collect()
    assert (a["tender_id"], a["reference"], a["status"], a["title"], a["organization"], a["procuring_entity"], a["method"], a["published_at"], a["closing_at"]) == ("901", "REF 1", "Live", "Supply of & chairs", "Org B", "PE C", "OTM", "2026-09-13T11:00", "2026-09-20T12:00")
    assert (b["status"], b["note"], b["organization"], b["method"], b["published_at"]) == ("", "Amendment issued: 1", "", "", None)


def test_contract_page(spark):
    page = """<table><tr><td>1</td><td>Min A</td><td>77, REF/1<br>Road repair 01-Sep-2026 10:00 tail</td><td>PE one<br>OTM</td><td>Dhaka</td><td>05-Sep-2026</td><td>M/S X</td><td>2,433.5</td></tr></table>"""
    r = html.contract_rows(spark.createDataFrame([(page,)], "html string")).first()
    assert (r["tender_id"], r["reference"], r["title"], r["advertised_at"], r["procuring_entity"], r["method"], r["signed_on"], r["awardee"], r["value_crore"]) == ("77", "REF/1", "Road repair", "2026-09-01T10:00", "PE one", "OTM", "2026-09-05", "M/S X", 2433.5)


def test_detail_page(spark):
    page = """<table><tr><td>Ministry :</td><td>Roads</td></tr><tr><td>Ministry :</td><td>Other</td></tr><tr><td>Category :</td><td>Chairs; Tables;</td></tr><tr><td>Tender/Proposal ID :</td><td>55</td></tr>
    <tr><td>1</td><td>a</td><td>b</td><td>1,000</td><td>c</td><td>d</td></tr><tr><td>Single</td><td>a</td><td>b</td><td>500</td><td>c</td><td>d</td></tr></table>"""
    r = html.detail_fields(html.details(spark.createDataFrame([(page,)], "html string"))).first()
    assert (r["tender_id"], r["ministry"], r["categories"], r["security_bdt"], r["brief"]) == ("55", "Roads", ["Chairs", "Tables"], 1500, "")


def test_plan_page_and_exact_package(spark):
    row = "<tr><td>1</td><td>214270</td><td>e</td><td>d</td><td>Works,</td><td>{}<br>text <a href='x?pkgId={}'>p</a></td><td>{}, OTM</td></tr>"
    page = row.format("W-1 a,", "5", "1039417.0") + row.format("W-1 ab", "6", "bad") + row.format("X", "7", "1") + row.format("x", "8", "2")
    plans = html.plan_rows(spark.createDataFrame([(page,)], "html string"))
    first = plans.where("pkg_id = '5'").first()
    assert (first["app_id"], first["nature"], first["estimate_bdt"], first["plan_method"]) == ("214270", "Works", 1039417.0, "OTM")
    wanted = spark.createDataFrame([("t1", "214270", "w-1A"), ("t2", "214270", "W-1"), ("t3", "214270", "X")], "tender_id string, app_id string, package_no string")
    got = {r["tender_id"]: (r["matched"], r["estimate_bdt"]) for r in html.matched_packages(wanted, plans).collect()}
    assert got == {"t1": (True, 1039417.0), "t2": (False, None), "t3": (False, None)}
