"""Plans and files of the steps that moved or held more than their input."""

import glob

import pytest
from pyspark.sql import functions as F
from conftest import rows

from tenderlake.operators import linkage, pages
from tenderlake.plans import registry
from tenderlake.plans.views import Views
from tenderlake.session import scratch_path
from tenderlake.sources import ledger as ledger_files, posts
from tenderlake.streaming import ledger_stream


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_joins_wide_rows_last(views, no_broadcast):
    # line items are shuffled by order last, and customers meet the orders only.
    found = [line for line in plan(views._ledger()).splitlines() if "Exchange hashpartitioning" in line]
    assert "l_orderkey" in found[0]
    assert all("l_" not in line for line in found if "o_custkey" in line)


def test_partitioned_tables_are_written_without_a_shuffle(spark, views):
    # F4, F5
    spark.sparkContext.setJobGroup("scale-store", "")
    kept = Views(spark, views.folder)._stored("scale-test", lambda: spark.range(100).withColumn("fiscal_year", (F.col("id") % 3).cast("int")), "fiscal_year")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("scale-store")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and kept.count() == 100


def _contracts(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("ctr_id"), F.concat(F.lit("c"), "id").alias("contract_id"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))).alias("vendor_name"),
        F.lit("01/01/2024").alias("start_date"), F.lit("01/01/2027").alias("end_date"), (F.col("id") + 1).cast("double").alias("award_amount"))


def _digital(spark):
    return spark.createDataFrame(
        [("v0", "Digital", "1"), ("v0", "Mixed", None), ("v1", "Mixed", "2"), ("v1", "Other", "3"), (None, "Digital", "4")],
        "vendor_name string, classification string, matched_passport_id string")


def test_digital_pages_join_narrow_rows(spark, no_broadcast):
    # only the contracts of the page meet the tags as a whole, the total meets none.
    contracts, digital = _contracts(spark, 100), _digital(spark)
    whole = contracts.join(digital.filter(F.col("classification") != "Other"), "vendor_name")
    for page in (1, 3, 99):
        got = pages.digital_contracts_page(contracts, digital, page=page)
        wanted = whole.orderBy(F.desc("award_amount"), "ctr_id", "classification").offset(10 * (page - 1)).limit(10)
        assert rows(got.drop("total_rows", "total_pages").select(*wanted.columns)) == rows(wanted)
        assert {tuple(r) for r in got.select("total_rows", "total_pages").collect()} <= {(whole.count(), -(-whole.count() // 10))}
    soon = pages.expiring_page(contracts, digital, F.to_date(F.lit("2026-01-01")), "amount", "desc", 2)
    wanted = whole.orderBy(F.desc("award_amount"), "ctr_id", "classification").offset(10).limit(10)
    assert rows(soon.select("contract_id", "classification")) == rows(wanted.select("contract_id", "classification"))
    assert rows(pages.digital_contracts_page(contracts, _digital(spark).limit(0))) == []
    wide = [line for line in plan(pages.digital_contracts_page(contracts, digital)).splitlines() if "HashAggregate" in line and "_contracts" in line]
    assert wide


def test_pieces_with_other_heads_are_not_made(spark):
    # F6, F7
    own = spark.createDataFrame([("v", "CT12345678"), ("v", "XXPO1234YY"), (None, None)], "_vendor string, _nid string")
    asked = spark.createDataFrame([("PO1234",), ("",), (None,)], "_nid string")
    lengths = linkage.lengths_of(asked, "_nid")
    got = linkage.with_pieces(own, "_nid", lengths, "_piece", linkage.heads_of(asked, "_nid"))
    assert {r["_piece"] for r in got.collect()} <= {r["_piece"] for r in linkage.with_pieces(own, "_nid", lengths, "_piece").collect()}
    assert {"PO1234", ""} <= {r["_piece"] for r in got.collect()} and got.filter("_piece like 'CT1%'").count() == 0


def test_vendor_payments_are_shuffled_once(spark, no_broadcast):
    # payments under a vendor's own name stay where the join has put them.
    vendors = spark.createDataFrame([("1", "Ann"), ("2", "Bob"), ("3", "Cy"), ("3", "Ann")], "passport_supplier_id string, name string")
    paid = spark.createDataFrame(
        [("Ann", f"2024-01-{d:02}", str(d)) for d in range(1, 9)] + [("Bob CORP", "2024-02-01", "1"), ("Bob INC", "2024-03-01", "2"), ("Zoe", None, "3")],
        "payee_name string, issue_date string, check_amount string")
    payees = paid.groupBy("payee_name").agg(F.count("*").alias("tx_count"))
    got = linkage.vendor_transactions(vendors, paid, payees, 3)
    assert rows(got.select("vendor_name", "payee_name", "issue_date", "rank")) == [
        ("Ann", "Ann", "2024-01-06", 3), ("Ann", "Ann", "2024-01-07", 2), ("Ann", "Ann", "2024-01-08", 1),
        ("Bob", "Bob CORP", "2024-02-01", 2), ("Bob", "Bob INC", "2024-03-01", 1)]
    own = plan(got).split("Union")[1]
    assert own.index("Window [row_number()") < own.index("SortMergeJoin")
    assert "Exchange" not in own[own.index("Window [row_number()"):own.index("SortMergeJoin")]


def test_landed_xml_files_are_bounded(spark, monkeypatch):
    # F10
    monkeypatch.setattr(registry, "XML_ROWS", 500, raising=False)
    root = []
    keep = registry.scratch_path
    monkeypatch.setattr(registry, "scratch_path", lambda s, label: root.append(keep(s, label)) or root[-1])
    got = registry.landing_xml(spark, "/root/testdata/sf0.001")
    files = glob.glob(f"{root[0].removeprefix('file://').removeprefix('file:')}/part-*")
    total = got.agg(F.sum("tx_count")).first()[0]
    assert total == Views(spark, "/root/testdata/sf0.001").ledger().count()
    assert all(open(f).read().count("<transaction>") <= 500 for f in files) and len(files) >= total / 500


def test_latest_payments_of_contracts_are_shuffled_once(spark, no_broadcast):
    # whole payments are shuffled by contract id for the join, and not again to be ranked; a second id needs the latter.
    contracts = spark.createDataFrame(
        [("1", "A-1", "01/01/2024", "01/01/2025"), ("2", "A-1", "01/01/2024", "01/01/2026"), (None, "B", "01/01/2024", "01/01/2025"), ("3", "C", "bad", None)],
        "ctr_id string, contract_id string, start_date string, end_date string")
    paid = spark.createDataFrame(
        [(c, f"202{y}-01-0{d}", 2020 + y, f"p{d}") for c in ("A1", "B", "C", None) for y in (3, 4, 5, 6) for d in range(1, 5)],
        "contract_id string, issue_date string, fiscal_year int, payee_name string")
    wide = [line for line in plan(linkage.contract_transactions(contracts, paid, F.lit(2026), 3)).splitlines() if "Exchange hashpartitioning" in line]
    assert not any(line.split("Exchange ")[1].startswith("hashpartitioning(ctr_id") and "payee_name" in line for line in wide)
    for found in (contracts, contracts.union(spark.createDataFrame([("1", "B", "01/01/2024", "01/01/2024")], contracts.schema))):
        got = linkage.contract_transactions(found, paid, F.lit(2026), 3)
        assert got.columns == ["contract_id", "fiscal_year", "ctr_id", "issue_date", "payee_name", "rank"]
        windows = linkage.fiscal_windows(found, F.lit(2026)).select("ctr_id", F.translate("contract_id", "-", "").alias("contract_id"), "first_fy", "last_fy")
        plain = sorted(windows.join(paid, "contract_id").where("fiscal_year between first_fy and last_fy").select("ctr_id", "issue_date", "contract_id").collect(), key=repr)
        per = {c: sorted((r.issue_date for r in plain if r.ctr_id == c), reverse=True)[:3] for c in {r.ctr_id for r in plain}}
        assert per == {c: [r.issue_date for r in sorted(got.collect(), key=lambda r: r["rank"]) if r.ctr_id == c] for c in per}
        assert got.count() == sum(map(len, per.values()))


def test_pages_of_a_stream_are_gathered_without_a_shuffle(spark, tmp_path, monkeypatch):
    # F8: the rows of many pages go to files by year, with as many tasks as there are cores or gathered pages.
    parts = spark.range(0, 400, 1, 40).select(F.col("id").cast("string").alias("payee_name"), (F.col("id") % 2 + 2024).cast("int").alias("fiscal_year"))
    monkeypatch.setattr(ledger_stream, "GATHERED", 10)
    spark.sparkContext.setJobGroup("scale-pages", "")
    ledger_stream.write_pages(parts, str(tmp_path / "ledger"), "one")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("scale-pages") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tasks) == [1, spark.sparkContext.defaultParallelism]
    back = ledger_files.read_ledger(spark, str(tmp_path / "ledger"))
    assert rows(back.groupBy("fiscal_year").count()) == [(2024, 200), (2025, 200)]
    assert len(glob.glob(f"{tmp_path}/ledger/fiscal_year=2024/batch=one/*.parquet")) == spark.sparkContext.defaultParallelism


def test_posts_are_written_by_many_tasks(spark, views, monkeypatch):
    # by the number of posts, not of bytes.
    monkeypatch.setattr(registry, "POSTS", 25)
    spark.sparkContext.setJobGroup("scale-posts", "")
    got = registry.post_files(spark, views.folder)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("scale-posts") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    n = views.table("pages").count()
    assert -(-n // 25) in tasks and got.count() == views.table("pages").select("page_id").distinct().count()


def test_posts_are_listed_by_group(spark, views, monkeypatch):
    # folders used to be moved, listed and typed one by one, with a task for each.
    monkeypatch.setattr(registry, "POSTS", 10)
    path, n = [], views.table("pages").count()
    monkeypatch.setattr(registry, "scratch_path", lambda *_: path.append(f"{scratch_path(*_)} x") or path[0])
    spark.sparkContext.setJobGroup("scale-post-groups", "")
    got = registry.post_files(spark, views.folder)
    assert got.count() == n
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("scale-post-groups") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) < n and len(glob.glob(f"{path[0]}/group=*/slug=*/*.txt")) == n
    assert not glob.glob(f"{path[0]}/**/.*", recursive=True)


def test_posts_on_other_file_systems_are_the_same(spark, tmp_path, monkeypatch):
    # the files that tasks write and read with Python, and those that Spark writes and reads.
    found = [(str(i), f"Title: {i}\n\nbody é\n") for i in range(40)]
    found += [(x, "odd") for x in ("a/b", "a=b", "a b", "100%", "q?{}[]^'\"", "é", "-5", "x\ty", "_hidden", ".hidden", "a|b<c>`")]
    found += [("7", "again"), ("7", None), ("8", ""), (None, None), (None, "Title: none"), ("", "Title: none")]
    raw = spark.createDataFrame(found, "slug string, raw string")
    read = []
    for k in range(2):
        posts.write_post_files(raw, f"{tmp_path}/{k}", 5)
        read.append(posts.read_post_files(spark, f"{tmp_path}/{k}"))
        monkeypatch.setattr(posts, "_local_path", lambda *_: None)
    python, native = [sorted((s, *sorted(r.split("\n"))) for s, r in rows(df)) for df in read]
    assert python == native and len(python) == 52 and read[0].schema == read[1].schema
    assert "again" in dict((x[0], x) for x in python)["7"]


def test_posts_in_several_batches_and_of_no_rows(spark, tmp_path, monkeypatch):
    # a task holds few files at a time; a table without rows gives no posts.
    monkeypatch.setattr(posts, "BATCH_BYTES", 10)
    raw = spark.range(25).selectExpr("cast(id as string) slug", "repeat('x', int(id)) raw")
    posts.write_post_files(raw, f"{tmp_path}/some", 2)
    assert rows(posts.read_post_files(spark, f"{tmp_path}/some")) == sorted((str(i), "x" * i + "\n") for i in range(25))
    posts.write_post_files(raw.filter("false"), f"{tmp_path}/none", 1)
    assert rows(posts.parse_posts(posts.read_post_files(spark, f"{tmp_path}/none"))) == []
