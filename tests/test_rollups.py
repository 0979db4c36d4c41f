from pyspark.sql import functions as F

from conftest import rows
from tenderlake.operators import ledger, pages, rollups
from tenderlake.plans import tools

CONTRACT = "ctr_id string, contract_id string, vendor_name string, agency_id string, agency string, status string, award_amount double, start_date string, end_date string"


def contracts(spark, *data):
    return spark.createDataFrame(list(data), CONTRACT)


def test_agency_without_contracts_and_ties(spark):
    agencies = spark.createDataFrame([("1", "Parks"), ("2", "Empty")], "id string, name string")
    c = contracts(spark, ("1", "x", "b", "1", "Parks", "O", 5.0, "", ""), ("2", "x", "a", "1", "Parks", "O", 5.0, "", ""),
                  ("3", "x", "c", "1", "Parks", "O", None, "", ""))
    assert rows(rollups.agency_rollup(agencies, c)) == [("1", "Parks", 3, 10.0, "a"), ("2", "Empty", 0, None, None)]
    assert rows(rollups.agency_rollup(agencies, c, q="PARK").select("id")) == [("1",)]


def test_sort_directions(spark):
    agencies = spark.createDataFrame([("1", "B"), ("2", "A")], "id string, name string")
    c = contracts(spark, ("1", "x", "b", "1", "B", "O", 5.0, "", ""), ("2", "x", "a", "2", "A", "O", 7.0, "", ""))
    for sort, order, first in (("name", "asc", "2"), ("name", "x", "1"), ("nope", "desc", "2"), ("amount", "asc", "1")):
        assert rollups.agency_rollup(agencies, c, sort=sort, order=order).first()["id"] == first


def test_year_window_and_unreadable_years(spark):
    c = contracts(spark, *[(str(i), "x", "v", "1", "a", "O", 1.0, d, "") for i, d in enumerate(
        ("01/01/2021", "01/01/2022", "12/31/2029", "01/01/2030", "01/01/20xx", "1/1/2023", None))])
    assert rows(rollups.award_by_start_year(c)) == [(2022, 1.0), (2029, 1.0)]


def test_empty_table(spark):
    empty = contracts(spark, ("1", "x", "v", "1", "a", "O", 1.0, "", "")).limit(0)
    assert rows(rollups.total_award(empty)) == [(0.0,)]
    assert rollups.contract_stats(empty).first()["total_amount"] is None
    assert rollups.status_breakdown(empty).count() == 0


def test_blank_groups(spark):
    c = contracts(spark, ("1", "x", "", "1", "a", "", 1.0, "", ""), ("2", "x", None, "1", "a", None, 2.0, "", ""),
                  ("3", "x", "v", "1", "a", "O", 3.0, "", ""))
    assert rows(rollups.top_by_award(c, "vendor_name")) == [("", 1.0), ("v", 3.0)]
    assert rows(rollups.top_by_award(c, "vendor_name", allow_blank=False)) == [("v", 3.0)]
    assert [r[0] for r in rollups.status_breakdown(c).collect()].count("Unknown") == 2


def test_digital_name_twice_counts_twice(spark):
    c = contracts(spark, ("1", "x", "v", "1", "a", "O", 2.0, "01/01/2023", "01/01/2027"))
    digital = spark.createDataFrame([("v", "Digital", "1"), ("v", "Mixed", None), ("v", "Other", "1")],
                                    "vendor_name string, classification string, matched_passport_id string")
    assert rows(rollups.digital_summary(c, digital)) == [(2, 4.0)]
    assert rows(rollups.digital_summary(c.limit(0), digital)) == [(0, 0.0)]
    assert pages.expiring(c, digital, F.to_date(F.lit("2027-01-01"))).count() == 2
    assert pages.expiring(c, digital, F.to_date(F.lit("2027-01-02"))).count() == 0


def test_trend_puts_missing_class_with_the_rest(spark):
    columns = ", ".join(f"{c} double" for c in rollups.FY_COLUMNS)
    data = [(k, *[v] * 10) for k, v in (("Digital", 1.0), ("Mixed", 2.0), (None, 4.0), ("Digital", None))]
    got = rollups.fy_trend(spark.createDataFrame(data, f"classification string, {columns}"))
    assert rows(got) == [(str(y), 1.0, 6.0) for y in range(2016, 2026)]


def test_timeline_aligns_months(spark):
    c = contracts(spark, ("1", "x", "v", "1", "a", "O", 2.0, "1/5/2023", ""), ("2", "x", "v", "1", "a", "O", 2.0, "01/01/2019", ""))
    s = spark.createDataFrame([("1", "", "02/01/2023"), ("1", "01/09/2023 12:00:00 AM", "")], "agency_id string, release_date string, due_date string")
    assert rows(rollups.agency_timeline(c, s)) == [("1", "2023-01", 1, 2.0, 1), ("1", "2023-02", 0, 0.0, 1)]


def test_chart_series(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "l string, n int")
    row = rollups.chart_series(df, F.col("n"), "l", "n").first()
    assert (row["labels"], row["data_values"]) == (["b", "c", "a"], [3, 2, 1])


def test_contract_profile_modes(spark):
    data = [("c", "b", "p", "2024-02-01", "1.00"), ("c", "a", "q", "2024-01-01", "N/A"), ("c", "a", None, "2024-03-01", "2.00"),
            ("c", "b", "q", "2024-01-15", "4.00"), ("d", None, None, None, None)]
    df = spark.createDataFrame(data, "contract_id string, agency string, payee_name string, issue_date string, check_amount string")
    assert rows(ledger.contract_profiles(df)) == [("c", "2024-01-01", "2024-03-01", 7.0, "a", "q"), ("d", None, None, None, None, None)]


def test_monthly_latest_drops_missing_after_the_limit(spark):
    df = spark.createDataFrame([("2024-01", 1.0), ("2024-02", 2.0), (None, 4.0)], "month string, total double")
    assert [r[0] for r in ledger.latest_months(df, 1).collect()] == ["2024-02"]
    assert [r[0] for r in ledger.latest_months(df, 3).collect()] == ["2024-01", "2024-02"]


def test_tools(spark, views):
    c, s, v = views.contracts(), views.solicitations(), views.vendors()
    one = c.orderBy("ctr_id").first()
    assert tools.get_contract_details(c, s, one["contract_id"]).first()["ctr_id"] == one["ctr_id"]
    assert tools.get_contract_details(c, s, "nothing").count() == 0
    vendor = v.filter(F.col("name") == one["vendor_name"]).first()
    profile = tools.get_vendor_profile(v, c, vendor["passport_supplier_id"]).first()
    assert profile["contract_count"] == c.filter(F.col("vendor_name") == vendor["name"]).count()
    assert len(profile["recent"]) == min(5, profile["contract_count"])
    epin = s.orderBy("epin").first()["epin"]
    assert tools.get_solicitation_details(s, c, epin).first()["contract_count"] >= 0
    parts = tools.get_agency_contracts(c, "nation_3", 3)
    assert parts["recent"].count() == 3 and parts["top_vendors"].count() == 5
    assert parts["summary"].first()["contract_count"] == c.filter("agency = 'NATION_3'").count()
    assert set(tools.get_contract_stats(c, fiscal_year=2023)) == {"stats", "by_status", "top_agencies"}
    assert tools.get_vendor_spending(views.ledger(), "corp")["by_year"].count() == 5
    for kind in ("spending_by_agency", "spending_by_year", "contracts_by_agency", "contracts_by_status"):
        assert tools.get_chart_data(c, views.ledger(), kind).columns == ["label", "value"]
    board = tools.dashboard(c, s, v)
    assert board["spending"].first()["total"] > 0 and board["counts"].count() == 3
    ledger_id = views.ledger().filter("contract_id like 'PO%'").first()["contract_id"]
    assert tools.contract_or_ledger(c, views.ledger(), ledger_id).first()["status"] == "Checkbook Record"
    assert tools.contract_or_ledger(c, views.ledger(), one["ctr_id"]).first()["contract_id"] == one["contract_id"]
    assert tools.get_spending_by_year(views.ledger(), 2024).count() == 10
    assert tools.search_transactions(views.ledger(), "corp", 7).count() == 7
    assert tools.get_vendor_stats(v).count() > 0 and tools.get_solicitation_stats(s, "nation_3").count() > 0
    assert tools.get_yearly_trends(c, s).count() > 0
    assert tools.get_database_overview(views.agencies(), v, c, s)["counts"].count() == 4
    tech = tools.tech_spending(views.digital())
    assert [r["year"] for r in tech["trend"].collect()] == [str(y) for y in range(2016, 2026)]
    report = tools.digital_report(v, c, views.digital(), views.contract_records(), F.to_date(F.lit("2025-06-30")))
    assert all(df.count() > 0 for df in report.values())
    detail = tools.agency_detail(c, s, v, "3")
    assert detail["stats"].count() == 1 and detail["vendors"].count() > 0


def test_detail_bundles_equal_the_set_based_result(spark, views):
    """One vendor or contract gives the rows that the query over all of them has for it."""
    from tenderlake.operators import linkage

    v, c, l = views.vendors(), views.contracts(), views.ledger()
    whole = linkage.reconcile_contracts(c, l, v).filter("vendor_name = 'Customer#000000007'")
    single = tools.vendor_detail(v, c, l, "7", views.children())
    assert rows(single["contracts"].select(*whole.columns)) == rows(whole)
    assert single["children"].count() > 0 and single["years"].count() > 0
    ctr = c.filter("vendor_name = 'Customer#000000007'").orderBy("ctr_id").first()["ctr_id"]
    bundle = tools.contract_detail(c, views.solicitations(), views.notices(), l, views.contract_records(), ctr, F.lit(2026))
    spending = linkage.contract_spending(c, l, F.lit(2026)).filter(F.col("ctr_id") == ctr)
    assert rows(bundle["spending"]) == rows(spending)
    assert bundle["record"].count() == 1 and bundle["contract"].count() == 1 and bundle["solicitation"].count() == 1
    assert bundle["notices"].count() == 0
