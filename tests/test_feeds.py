import pytest
from pyspark.sql import functions as F

from conftest import rows
from tenderlake.operators import linkage
from tenderlake.plans import registry
from tenderlake.sources import exports, feeds, landing, ledger, posts, progress


def _write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_vendor_feed(spark, tmp_path):
    """BOM, quotes, line breaks, empty cells, absent headers, repeated keys."""
    path = _write(tmp_path / "v.csv", (
        "﻿PASSPort Supplier-ID,Vendor Name,Ethnicity,Business Category\n"
        '1,"Acme, ""Best""\nInc",,Retail\n'
        "1,Later,x,Retail\n"
        ',"first blank",,\n'
        ",second blank,,\n"
    ))
    got = feeds.read_vendors(spark, path).select("passport_supplier_id", "name", "ethnicity", "duns_number")
    assert rows(got) == [("", "first blank", "", None), ("1", 'Acme, "Best"\nInc', "", None)]


def test_last_loaded_vendor_of_a_name_wins(spark, tmp_path):
    path = _write(tmp_path / "v.csv", "PASSPort Supplier-ID,Vendor Name\n9,Acme\n2,ACME\n")
    vendors = feeds.read_vendors(spark, path, keep_order=True)
    entities = spark.createDataFrame([("acme",)], "organization_name string")
    assert linkage.match_entities(entities, vendors, order=feeds.ORDER).first()["matched_vendor_id"] == "2"
    assert linkage.match_entities(entities, vendors).first()["matched_vendor_id"] == "9"


def test_input_order_spans_files(spark, tmp_path):
    _write(tmp_path / "a.csv", "EPIN,Procurement Name\nE1,from a\n")
    _write(tmp_path / "b.csv", "EPIN,Procurement Name\n" + "E1,from b\n" * 50 + "E2,first of b\nE2,second\n")
    got = feeds.read_solicitations(spark, str(tmp_path)).select("epin", "normalized_epin", "procurement_name")
    assert rows(got) == [("E1", "E1", "from a"), ("E2", "E2", "first of b")]


def test_contract_feed_keeps_duplicates(spark, tmp_path):
    path = _write(tmp_path / "c.csv", (
        "CTR-ID,EPIN,Contract ID,Award Amount,Current Contract Amount\n"
        '5,85826-Y1251001,ct1-846,"$1,234.50",(5)\n5,85826-Y1251001,ct1-846,,N/A\n6,,,1,2\n'
    ))
    got = feeds.read_contracts(spark, path).select("ctr_id", "normalized_contract_id", "base_epin", "award_amount", "current_amount")
    assert rows(got) == sorted([("5", "CT1846", "85826Y1251", 0.0, 0.0), ("5", "CT1846", "85826Y1251", 1234.5, 5.0),
                                ("6", None, None, 1.0, 2.0)], key=repr)


def test_notice_feed(spark, tmp_path):
    path = _write(tmp_path / "n.csv", (
        "RequestID,PIN,AdditionalDesctription2,any-org-id\n1, 85826Y1251 ,more,9\n2,SEE BELOW,,\n3,12345678,,\n3,87654321,,\n"
    ))
    valid = feeds.read_notices(spark, path, only_valid=True).select("RequestID", "PIN", "AdditionalDescription2", "org_id")
    assert rows(valid) == [("1", " 85826Y1251 ", "more", "9"), ("3", "12345678", "", "")]
    assert feeds.read_notices(spark, path).count() == 3
    assert len(feeds.NOTICES) == 39


def test_entities_people_and_children(spark, tmp_path):
    path = _write(tmp_path / "e.csv", "organization_name,doing_business_start_date\nAcme & Co,2020\nAcme & Co,2020\n")
    assert rows(feeds.read_entities(spark, path).select("normalized_name", "start_date")) == [("ACMECO", "2020")] * 2
    path = _write(tmp_path / "p.csv", "organization_name,person_name_last\nAcme,Doe\n")
    assert rows(feeds.read_people(spark, path).select("normalized_org_name", "last_name")) == [("ACME", "Doe")]
    path = _write(tmp_path / "o.csv", "Vendor Name,Other Name,To Date \nAcme,AKA,2020\n")
    assert rows(feeds.read_child(spark, path, "other_names").select("vendor_name", "other_name", "to_date")) == [("Acme", "AKA", "2020")]
    path = _write(tmp_path / "s.csv", "Vendor Name,Address  Line 2\nAcme,Floor 2\n")
    assert feeds.read_child(spark, path, "entity_summary").first()["address2"] == "Floor 2"
    for feed in feeds.CHILD_FEEDS:
        assert feeds.read_child(spark, str(tmp_path / "missing.csv"), feed).count() == 0


def test_missing_feed_is_empty(spark, tmp_path):
    got = feeds.read_vendors(spark, str(tmp_path / "none.csv"))
    assert got.columns == list(feeds.VENDORS.values()) and got.count() == 0


def test_agency_dimension(spark):
    s = spark.createDataFrame([("1", "Parks", 2), ("1", "Old Parks", 1), ("", "x", 1), ("3", "", 1)], "agency_id string, agency string, n int")
    c = spark.createDataFrame([("1", "Parks Dept", 0), ("2", "Roads", 5)], "agency_id string, agency string, n int")
    assert rows(feeds.agency_dimension(s, c, "n")) == [("1", "Old Parks"), ("2", "Roads")]


def test_line_count(spark, tmp_path):
    _write(tmp_path / "a.csv", "h\n1\n2\n")
    _write(tmp_path / "b.csv", "")
    _write(tmp_path / "c.csv", "h\n1\n")
    assert feeds.line_count(spark, str(tmp_path)).first()[0] == 3


def test_ledger_files(spark, tmp_path):
    """Columns merge by name, the folder names the year, a year filter prunes."""
    root = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", 2023, "1.00")], "payee_name string, fiscal_year int, check_amount string")
    ledger.write_ledger(one, root)
    two = spark.createDataFrame([("b", 2024, 2.5, "Parks")], "payee_name string, fiscal_year int, check_amount double, department string")
    ledger.write_ledger(two, root)
    got = ledger.read_ledger(spark, root)
    assert rows(got.select("payee_name", "fiscal_year", "check_amount", "department")) == [("a", 2023, "1.00", None), ("b", 2024, "2.5", "Parks")]
    assert rows(ledger.read_ledger(spark, root, [2024]).select("payee_name")) == [("b",)]
    listed = ledger.read_files(spark, [f"{root}/fiscal_year=2023", f"{root}/fiscal_year=2024"], root)
    assert listed.count() == 2 and "fiscal_year" in listed.columns


def test_row_year_beats_nothing_else(spark):
    df = spark.createDataFrame([("2020", "2024-08-01"), (None, "2024-08-01"), ("x", "06/30/2024")], "fiscal_year string, issue_date string")
    assert [r[0] for r in ledger.with_fiscal_year(df).collect()] == [2020, 2025, 2024]


def test_landing_formats(spark, tmp_path):
    xml = "<response><transactions><transaction><agency>Parks</agency><check_amount>5.00</check_amount></transaction>" \
          "<transaction><agency>Roads</agency></transaction></transactions></response>"
    _write(tmp_path / "page.xml", xml)
    got = landing.read_landing(spark, str(tmp_path / "page.xml"), "xml")
    assert rows(got.select("agency", "check_amount")) == [("Parks", "5.00"), ("Roads", None)]
    _write(tmp_path / "rows.json", '{"agency": "Parks", "check_amount": "1"}\n')
    assert landing.read_landing(spark, str(tmp_path / "rows.json"), "json").first()["agency"] == "Parks"


def test_progress_files(spark, tmp_path):
    _write(tmp_path / "progress_fy2024.json", '{"total_records": 5, "last_record_downloaded": 4, "chunks_completed": ["a"], "last_updated": "2024-01-01"}')
    _write(tmp_path / "progress_fy2025.json", "{broken")
    got = progress.read_progress(spark, str(tmp_path / "progress_fy*.json"))
    assert got.agg(F.sum("total_records"), F.sum("last_record_downloaded")).first() == (5, 4)


def test_posts(spark, tmp_path):
    _write(tmp_path / "old.md", "Title: Old\nDate: 2023-01-01\n\n<p>Text &amp; more</p>")
    _write(tmp_path / "new.md", "Title: New\nDate: 2024-01-01\nExcerpt: short\nAuthor: Ann\n\nBody")
    _write(tmp_path / "bare.md", "\nBody only")
    got = posts.newest(posts.parse_posts(posts.read_post_files(spark, str(tmp_path))))
    assert [(r["slug"], r["title"], r["author"], r["excerpt"]) for r in got.collect()] == [
        ("new", "New", "Ann", "short"), ("old", "Old", "", "Text & more..."), ("bare", "Untitled", "", "Body only...")]


def test_csv_export_reads_back(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", text\nline', ""), ("b", "x")], "Vendor_Name string, y string")
    ledger.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out")).na.fill("")
    assert rows(back) == rows(df)


def test_chunk_to_ledger_and_records(spark, tmp_path):
    header = ",".join(ledger.FIELDS)
    _write(tmp_path / "chunk.csv", f"{header}\nParks,a,5,,2024-08-01,,,,,,,,\nParks,b,x,2021,2024-08-01,,,,,,,,\n")
    root = str(tmp_path / "ledger")
    ledger.load_chunk(spark, str(tmp_path / "chunk.csv"), root)
    assert rows(ledger.read_ledger(spark, root).select("payee_name", "check_amount", "fiscal_year")) == [("a", "5", 2025), ("b", "x", 2021)]
    assert ledger.read_contract_records(spark, root, range(2020, 2026)).count() == 2
    assert ledger.read_contract_records(spark, root, 2021).count() == 1


def test_read_through(spark, tmp_path):
    path, built = str(tmp_path / "stats"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("2024-01", 1.0)], "month string, total double")

    for _ in range(2):
        assert rows(exports.read_through(spark, path, build, "json")) == [("2024-01", 1.0)]
    assert built == [1]


def test_exports_and_listing(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(1200)], "n int").coalesce(1)
    exports.export_csv(df, str(tmp_path), "numbers.csv")
    with pytest.raises(ValueError):
        exports.export_csv(df, str(tmp_path), "numbers.db")
    now = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    listed = exports.dataset_info(spark, {"Numbers": str(tmp_path / "numbers.csv"), "None": str(tmp_path / "none.csv")}, now)
    got = {r["name"]: (r["record_count"], r["last_updated"], r["next_update"]) for r in listed.collect()}
    assert got["Numbers"][0] == "1,200" and got["Numbers"][2] == "2026-01-02 02:00:00"
    assert got["None"][:2] == ("-", "Not Found")


def test_feed_headers_are_complete():
    assert registry.feeds.CONTRACTS["Vendor"] == "vendor_name"
    assert [len(x) for x in (feeds.VENDORS, feeds.SOLICITATIONS, feeds.CONTRACTS, feeds.ENTITY_SUMMARY)] == [8, 13, 16, 12]
