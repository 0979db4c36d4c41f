"""Shapes of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import linkage, pages, rollups
from tenderlake.operators import ledger as led
from tenderlake.operators.ranking import top_per_group
from tenderlake.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(registry.VIEW_QUERIES))
def test_no_pairwise_join_and_no_python(spark, no_broadcast, name):
    from conftest import SMALL

    text = plan(registry.queries()[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in text, node


def test_year_filter_prunes_partitions(views):
    text = plan(led.in_years(views.ledger(), years=led.DEFAULT_YEARS).groupBy("agency").count())
    assert "PartitionFilters: [isnotnull(fiscal_year" in text or "PartitionFilters: [fiscal_year" in text


def test_contract_window_prunes_at_run_time(spark, views):
    one = views.contracts().filter("ctr_id = '7'")
    assert "dynamicpruning" in plan(linkage.contract_transactions(one, views.ledger(), F.lit(2026)))


def test_columns_are_pruned(views):
    text = plan(rollups.top_by_award(views.contracts(), "agency"))
    assert "ReadSchema: struct<agency:string,award_amount:double>" in text


def test_groups_are_limited_before_the_shuffle(views):
    text = plan(led.latest_per_payee(views.ledger(), 5))
    assert text.count("WindowGroupLimit") == 2


def test_long_lists_are_ranked_in_parts_first(views):
    text = plan(top_per_group(views.ledger(), ["payee_name"], [F.col("issue_date")], 500))
    assert text.count("row_number()") >= 2 and "_part" in text


def test_latest_rows_are_cut_by_counts_and_shuffled_whole_once(views):
    text = plan(led.latest_per_payee(views.ledger()))
    assert "ReadSchema: struct<issue_date:string,payee_name:string>" in text
    assert len([x for x in text.split("\n") if "Exchange hashpartitioning(payee_name" in x and "Broadcast" not in x]) <= 4
    before = text[text.index("Window [row_number()"):]
    assert "_cut" in before and "_part" not in text


def test_contract_spending_reads_only_the_years_of_its_windows(views):
    text = plan(linkage.contract_spending(views.contracts(), views.ledger(), F.lit(2026)))
    assert "PartitionFilters: [isnotnull(fiscal_year" in text and "Subquery" in text[text.index("PartitionFilters: [isnotnull(fiscal_year"):]


def test_contract_profiles_expand_groups_only(views):
    text = plan(led.contract_profiles(views.ledger()))
    assert "Expand" in text and "Exchange" in text[text.index("Expand"):]


def test_masked_pieces_are_equi_joins(views):
    text = plan(linkage.partial_links(views.notices(), views.solicitations()))
    assert "_mask" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_reconcile_goes_to_the_ledger_for_ids_and_what_is_left_over(views):
    text = plan(linkage.reconcile_contracts(views.contracts(), views.ledger(), views.vendors()))
    assert text.count("FileScan") < 15


def test_stored_columns_spare_the_footers(spark, views, tmp_path):
    from tenderlake.sources import ledger

    root = str(tmp_path / "ledger")
    ledger.write_ledger(views.ledger().limit(10), root)
    assert ledger._stored_schema(spark, root).names[-2:] == ["fiscal_year", "batch"]
    more = views.ledger().limit(10).withColumn("extra", F.lit("x"))
    ledger.write_ledger(more, root)
    assert ledger.read_ledger(spark, root).where("extra is null").count() == 10


def test_pages_are_top_k(views):
    text = plan(views.contracts().orderBy("ctr_id").offset(50).limit(50))
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("page", [1, 2])
def test_every_page_of_a_list_is_top_k(views, page):
    c, s, d = views.contracts(), views.solicitations(), views.digital()
    lists = [
        pages.contracts_page(c, s, page=page), pages.solicitations_page(s, c, page=page), pages.digital_contracts_page(c, d, page=page),
        pages.expiring_page(c, d, F.to_date(F.lit("2025-06-30")), page=page), pages.digital_vendors_page(views.vendors(), d, c, page=page),
    ]
    for shown in lists:
        text = plan(shown)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
