"""Linkage against brute force over small tables that hold the awkward cases."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tenderlake.operators import linkage, quality
from tenderlake.operators.ledger import payee_totals
from tenderlake.operators.profiles import tech_row, vendor_people


def sql_like(text, pattern):
    expr = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(expr, text, re.S) is not None


def test_entities_last_vendor_wins_and_blank_never_matches(spark):
    entities = spark.createDataFrame([("1", "acme inc"), ("2", "..."), ("3", "none")], "id string, organization_name string")
    vendors = spark.createDataFrame([("10", "Acme, Inc."), ("11", "ACME INC"), ("12", "-")], "passport_supplier_id string, name string")
    got = {r["id"]: (r["matched_vendor_id"], r["match_score"]) for r in linkage.match_entities(entities, vendors).collect()}
    assert got == {"1": ("11", 1.0), "2": (None, None), "3": (None, None)}
    blank = linkage.match_entities(entities, vendors, match_blank=True).filter("id = '2'").first()
    assert blank["matched_vendor_id"] == "12"


def test_partial_links_match_the_theta_join(spark):
    rng = random.Random(5)
    keys = ["".join(rng.choice("AB0") for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None, ""]
    pins = ["".join(rng.choice("ab0-") for _ in range(rng.randint(0, 11))) for _ in range(60)]
    pins += ["a%b", "a_b0", "____", "%", "%%a", "ab_%0a", "________", "", None, "-", "AAAAAAAAZZZ"]
    notices = spark.createDataFrame([(str(i), p) for i, p in enumerate(pins)], "RequestID string, PIN string")
    solicitations = spark.createDataFrame([(k,) for k in keys], "normalized_epin string")
    expected = {
        str(i) for i, p in enumerate(pins)
        if p is not None and any(k is not None and sql_like(k, f"%{p.replace('-', '').upper()[:8]}%") for k in keys)
    }
    assert {r[0] for r in linkage.partial_links(notices, solicitations).select("RequestID").collect()} == expected


def test_prefix_join(spark):
    s = spark.createDataFrame([("e0", "", "a"), ("e1", "AB", "a"), ("e2", "ABC", "a"), ("e3", None, "a"), ("e4", "ZZZ", "a")],
                              "epin string, normalized_epin string, agency string")
    contracts = [("1", "AB", 1.0), ("2", "ABCD", 2.0), ("3", "ABC", 4.0), ("4", None, 8.0), ("5", "X", 16.0), ("6", "ABCD", 32.0)]
    c = spark.createDataFrame([(i, "c" + i, e, "v", a) for i, e, a in contracts],
                              "ctr_id string, contract_id string, normalized_epin string, vendor_name string, award_amount double")
    got = {r["epin"]: (r["contract_count"], r["total_awarded"]) for r in linkage.solicitation_contracts(s, c).collect()}
    assert got == {"e0": (5, 55.0), "e1": (4, 39.0), "e2": (3, 38.0), "e3": (0, 0.0), "e4": (0, 0.0)}
    few = linkage.solicitation_first_contracts(s, c, 2)
    assert rows(few.select("epin", "ctr_id")) == [("e0", "1"), ("e0", "2"), ("e1", "1"), ("e1", "2"), ("e2", "2"), ("e2", "3")]


def test_two_tiers(spark):
    s = spark.createDataFrame([("s1", "85826Y1251"), ("s2", "85826Y1251001")], "epin string, normalized_epin string")
    c = spark.createDataFrame([("1", "a", "85826Y1251001"), ("2", "b", "85826Y1251002"), ("3", "c", "85826Y125"), ("4", "d", None)],
                              "ctr_id string, contract_id string, normalized_epin string")
    got = {r["ctr_id"]: (r["solicitation_epin"], r["tier"]) for r in linkage.two_tier_solicitation(c, s).collect()}
    assert got == {"1": ("s2", "exact"), "2": ("s1", "base"), "3": (None, "none"), "4": (None, "none")}


def _reconcile(spark, contracts, payments):
    c = spark.createDataFrame(
        [(str(i), cid, v, "ag", "1", 1.0, "01/02/2024", "01/03/2024", "O") for i, (v, cid) in enumerate(contracts)],
        "ctr_id string, contract_id string, vendor_name string, agency string, agency_id string, award_amount double,"
        " start_date string, end_date string, status string")
    ledger = spark.createDataFrame(
        [(p, cid, "paying", "2024-05-01", "2.50") for p, cid in payments],
        "payee_name string, contract_id string, agency string, issue_date string, check_amount string")
    vendors = spark.createDataFrame([("v",), ("w",)], "name string")
    return linkage.reconcile_contracts(c, ledger, vendors)


@pytest.mark.parametrize("seed", range(3))
def test_reconcile_matches_brute_force(spark, seed):
    rng = random.Random(seed)

    def some_id():
        return "".join(rng.choice("ab- 1") for _ in range(rng.randint(0, 6)))

    contracts = [(rng.choice("vwx"), some_id()) for _ in range(25)]
    payments = [(rng.choice("vwx"), some_id()) for _ in range(40)]
    norm = lambda s: s.replace("-", "").replace(" ", "").upper()
    hits, only = set(), set()
    for vendor, cid in set(payments):
        if vendor == "x" or not cid:
            continue
        own = sorted({norm(c) for v, c in contracts if v == vendor and norm(c)})
        nid = norm(cid)
        fits = [nid] if nid in own else [o for o in own if nid in o or o in nid][:1]
        hits |= {(vendor, f) for f in fits}
        only |= set() if fits else {(vendor, cid)}
    expected = [(v, c, "MOCS & Checkbook" if (v, norm(c)) in hits else "MOCS") for v, c in contracts if v != "x"]
    expected += [(v, c, "Checkbook") for v, c in only]
    got = _reconcile(spark, contracts, payments).select("vendor_name", "contract_id", "source")
    assert rows(got) == sorted(expected, key=repr)


def test_ledger_only_row(spark):
    row = _reconcile(spark, [("v", "CT1-1")], [("v", "PO7"), ("v", "PO7")]).filter("source = 'Checkbook'").first()
    assert (row["ctr_id"], row["agency"], row["award_amount"], row["start_date"], row["status"]) == (
        "PO7", "paying", 5.0, "2024-05-01", "Checkbook Only")


def test_names_contained_in_payees(spark):
    names = ["Customer#000010", "ACME", "A%B Group", "Customer", "no such vendor", "x_z", "%", "LONGEST NAME OF ALL"]
    payees = ["Customer#000010 CORP", "Customer#0000101", "THE ACME CO", "A and B Group Inc", "xyz", "", "acme",
              "THE LONGEST NAME OF ALL LLC", "LONGEST NAME"]
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    seen = spark.createDataFrame([(p,) for p in [*payees, None]], "payee_name string")
    expected = sorted(((n, p) for n, p in itertools.product(names, payees) if sql_like(p, f"%{n}%")), key=repr)
    assert rows(linkage.names_containing(wanted, seen)) == expected


def test_vendor_payees_tiers(spark):
    vendors = spark.createDataFrame([("1", "Alpha Works"), ("2", "Beta Builders"), ("3", "Gamma")], "passport_supplier_id string, name string")
    ledger = spark.createDataFrame(
        [("Alpha Works", "1.00", "2024-01-01"), ("Alpha Works II", "9.00", "2024-01-01"),
         ("The Beta Builders", "2.00", "2024-02-01"), ("Beta Builders Co", "N/A", "2024-03-01")],
        "payee_name string, check_amount string, issue_date string")
    got = {r[0]: tuple(r)[2:] for r in linkage.vendor_payees(vendors, payee_totals(ledger)).collect()}
    assert got == {"1": ("exact", 1, 1, 1.0, "2024-01-01"), "2": ("contains", 2, 2, 2.0, "2024-03-01"),
                   "3": ("none", 0, 0, None, None)}
    latest = linkage.vendor_transactions(vendors, ledger, payee_totals(ledger), 1)
    assert rows(latest.select("vendor_name", "payee_name")) == [("Alpha Works", "Alpha Works"), ("Beta Builders", "Beta Builders Co")]


def test_award_years_fall_back_to_the_wildcard(spark):
    vendors = spark.createDataFrame([("ACME CORP",), ("BUILDIT",), ("SHORT",), ("EXACT NAME",)], "name string")
    records = spark.createDataFrame(
        [("ACME INC", "c1", "2020-03-01", "5.00"), ("ACME INC", "c1", "2019-01-01", "7.00"), ("BUILDIT LLC", "c2", "2021-01-01", "1.00"),
         ("SHORT ONE", "c3", "2021-01-01", "1.00"), ("EXACT NAME", "c4", "2022-01-01", "3.00"), ("EXACT NAME B", "c5", "2022-01-01", "4.00"),
         ("EXACT NAME", "c6", None, "8.00"), ("EXACT NAME", "c7", "2023-01-01", "bad")],
        "prime_vendor string, prime_contract_id string, prime_contract_start_date string, prime_contract_original_amount string")
    assert rows(linkage.award_years(vendors, records)) == [
        ("ACME CORP", "wildcard", 2019, 7.0), ("BUILDIT", "wildcard", 2021, 1.0), ("EXACT NAME", "exact", 2022, 3.0)]


def test_contract_spending_window_and_total(spark):
    contracts = spark.createDataFrame([("1", "CT-1", "08/01/2020", "07/01/2021")],
                                      "ctr_id string, contract_id string, start_date string, end_date string")
    ledger = spark.createDataFrame([("CT1", y, a) for y, a in ((2019, "1.00"), (2020, "2.00"), (2024, "4.00"), (2024, "N/A"), (2025, "8.00"))],
                                   "contract_id string, fiscal_year int, check_amount string")
    # Fiscal years 2021 to 2022 reach from 2020 to 2024.
    assert rows(linkage.contract_spending(contracts, ledger, F.lit(2026))) == [
        ("1", "2020", 2.0, 1), ("1", "2024", 4.0, 2), ("1", "ALL", 6.0, 3)]
    payments = ledger.withColumn("issue_date", F.concat(F.col("fiscal_year").cast("string"), F.lit("-01-01")))
    latest = linkage.contract_transactions(contracts, payments, F.lit(2026), 2)
    assert rows(latest.select("fiscal_year", "check_amount")) == [(2024, "4.00"), (2024, "N/A")]


def test_notice_key_validity(spark):
    bad = ["", "1234567", "SEE BELOW", "NoPINFound", "00000000", "0000.0000", "see attached", "line 17 below", None, "  1234567 "]
    good = ["85826Y1251", "12345678", " 12345678 "]
    df = spark.createDataFrame([(x,) for x in bad + good], "PIN string")
    assert {r[0] for r in df.filter(quality.valid_notice_key()).collect()} == set(good)


def test_freshness(spark):
    df = spark.createDataFrame([("a", 0, 0, None), ("b", 20, 10, "2024-01-01"), ("c", 20, 20, ""), ("c", 5, 5, "2024-02-01")],
                               "k string, total_records long, last_record_downloaded long, last_updated string")
    got = {r["k"]: (r["total_records"], r["status"], r["last_updated"]) for r in quality.freshness(df, None, "k").collect()}
    assert got == {"a": (0, "N/A", "N/A"), "b": (20, "In Progress", "2024-01-01"), "c": (25, "Up to Date", "2024-02-01")}
    assert quality.freshness(df.filter("k = 'z'")).first()["status"] == "N/A"


def test_people_and_tech(spark):
    vendors = spark.createDataFrame([("1", "Acme"), ("2", "Beta")], "passport_supplier_id string, name string")
    matched = spark.createDataFrame([("1", "ACMEHOLDING")], "matched_vendor_id string, normalized_name string")
    people = spark.createDataFrame([("ACMEHOLDING", "Ann"), ("ACME", "Abe"), ("BETA", "Bea")], "normalized_org_name string, last_name string")
    got = rows(vendor_people(vendors, matched, people).select("passport_supplier_id", "last_name"))
    assert got == [("1", "Ann"), ("2", "Bea")]
    digital = spark.createDataFrame([("Other name", "1", "Digital"), ("Beta", None, "Mixed"), ("Acme", None, "Other")],
                                    "vendor_name string, matched_passport_id string, classification string")
    assert rows(tech_row(vendors, digital)) == [("1", "Digital"), ("2", "Mixed")]
