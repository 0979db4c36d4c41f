"""Inputs that the given tables do not hold."""

import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tenderlake.operators import linkage, profiles, search
from tenderlake.operators.ranking import first_per_key, top_per_group
from tenderlake.plans.views import Views
from tenderlake.sources import feeds, ledger
from tenderlake.streaming import ledger_stream

COLUMNS = ["payee_name", "check_amount", "issue_date"]
SCHEMA = feeds.text_schema(COLUMNS)


def test_files_with_another_header_fail(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    (folder / "a.csv").write_text("PASSPort Supplier-ID,Vendor Name\n1,Alpha\n")
    (folder / "b.csv").write_text("Vendor Name,PASSPort Supplier-ID\nBeta,2\n")
    with pytest.raises(Exception, match="header"):
        feeds.read_vendors(spark, str(folder)).collect()
    parts = [feeds.read_vendors(spark, str(folder / f)) for f in ("a.csv", "b.csv")]
    got = parts[0].unionByName(parts[1]).select("passport_supplier_id", "name")
    assert rows(got) == [("1", "Alpha"), ("2", "Beta")]


def test_ambiguous_header_endings_fail(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("CTR-ID,a-org-id,b-org-id\n1,x,y\n")
    with pytest.raises(ValueError, match="org-id"):
        feeds.read_contracts(spark, str(path))
    named = {("b-org-id" if h == "-org-id" else h): c for h, c in feeds.CONTRACTS.items()}
    assert feeds.read_contracts(spark, str(path), headers=named).first()["agency_id"] == "y"


def _land(spark, path, data):
    ledger.write_csv(spark.createDataFrame(data, SCHEMA), path)


def test_bulk_and_stream_share_a_ledger(spark, tmp_path):
    landing, target, state = (str(tmp_path / x) for x in ("landing", "ledger", "state"))
    bulk = spark.createDataFrame([("bulk", "1.00", "2024-01-05", 2024)], "payee_name string, check_amount string, issue_date string, fiscal_year int")
    ledger.write_ledger(bulk, target)
    _land(spark, landing, [("stream", "2.00", "2024-01-06")])
    assert ledger_stream.ingest(spark, landing, target, state, schema=SCHEMA, timeout=120)
    ledger.write_ledger(bulk.withColumn("payee_name", F.lit("later")), target)
    assert {r["payee_name"] for r in ledger.read_ledger(spark, target).collect()} == {"bulk", "stream", "later"}


def test_repeated_batch_replaces_its_files(spark, tmp_path):
    target = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", "1", 2024), ("b", "2", 2025)], "payee_name string, check_amount string, fiscal_year int")
    ledger_stream.write_batch(one.filter("fiscal_year = 2024"), target, "q-000000")
    for _ in range(2):
        ledger_stream.write_batch(one, target, "q-000000")
    ledger_stream.write_batch(one, target, "q-000001")
    assert ledger.read_ledger(spark, target).columns == ["payee_name", "check_amount", "fiscal_year"]
    assert rows(ledger.read_ledger(spark, target).groupBy("fiscal_year").count()) == [(2024, 2), (2025, 2)]


def test_months_of_two_checkpoints_add_up(spark, tmp_path):
    rollup = str(tmp_path / "months")
    for k, amount in enumerate(("10.00", "5.00")):
        landing = str(tmp_path / f"landing{k}")
        _land(spark, landing, [("a", amount, "2024-06-15")])
        assert ledger_stream.maintain_monthly(spark, landing, rollup, str(tmp_path / f"state{k}"), schema=SCHEMA, timeout=120)
    assert rows(ledger_stream.read_monthly(spark, rollup)) == [("2024-06", 15.0, 2)]


def test_replaced_tables_are_read_anew(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree("/root/testdata/sf0.001", folder)
    before = Views(spark, folder).contracts().count()
    (tmp_path / "sf" / "orders.parquet").chmod(0o644)
    (tmp_path / "sf").chmod(0o755)
    pq.write_table(pq.read_table("/root/testdata/sf0.001/orders.parquet").slice(0, 100), f"{folder}/orders.parquet")
    assert before > 100 and Views(spark, folder).contracts().count() == 100


def test_blank_names_meet_nobody(spark):
    vendors = spark.createDataFrame([("1", "-"), ("2", "Acme")], "passport_supplier_id string, name string")
    matched = spark.createDataFrame([], "matched_vendor_id string, normalized_name string")
    people = spark.createDataFrame([("Nobody", ""), ("Ann", "ACME")], "last_name string, normalized_org_name string")
    assert [r["last_name"] for r in profiles.vendor_people(vendors, matched, people).collect()] == ["Ann"]


def test_short_names_find_all_payees(spark):
    vendors = spark.createDataFrame([("1", "Li"), ("2", "Q")], "passport_supplier_id string, name string")
    payees = spark.createDataFrame([(f"Li {i}",) for i in range(50)] + [("Zed",)], "payee_name string")
    got = linkage.names_containing(vendors, payees)
    assert rows(got) == sorted([("Li", f"Li {i}") for i in range(50)], key=repr)


def test_long_lists_equal_one_ranking(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"), "id")
    got = top_per_group(df, ["g"], [F.col("v"), F.col("id")], 40)
    for g in range(3):
        want = sorted((i * 7919 % 1000, i) for i in range(3000) if i % 3 == g)[:40]
        assert [(r["v"], r["id"]) for r in got.filter(F.col("g") == g).orderBy("rank").collect()] == want


def test_repeated_names_keep_the_last(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "name string, n int")
    assert rows(first_per_key(df, "name", [F.col("n").desc()])) == [("A", 2), ("B", 3)]


def test_pages_by_key_equal_pages_by_number(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(40)], "v int, id int")
    keys, last, seen = {"v": False, "id": True}, None, []
    while True:
        page = [r.asDict() for r in search.rows_after(df, keys, last, 7).collect()]
        if not page:
            break
        seen += [(r["v"], r["id"]) for r in page]
        last = page[-1]
    assert seen == sorted(((i % 5, i) for i in range(40)), key=lambda r: (-r[0], r[1]))
