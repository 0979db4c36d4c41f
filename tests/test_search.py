import pytest
from pyspark.sql import functions as F

from conftest import rows
from tenderlake.operators import pages, search
from tenderlake.operators.ranking import append, first_per_key, last_per_key


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("", 4), (None, 5), (None, 6)], "k string, n int")
    assert rows(first_per_key(df, "k", [F.col("n")])) == sorted([("", 3), ("a", 1), (None, 5), (None, 6)], key=repr)
    assert rows(last_per_key(df, "k", ["n"])) == [("", 4), ("a", 2)]


def test_append_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    assert rows(append(a, spark.createDataFrame([(1,)], "n int"))) == [(1, "x"), (1, None)]


def test_certification_classes(spark):
    df = spark.createDataFrame([(x,) for x in ("MBE", "WBE", "Non-MWBE", "", None, "MBE/WBE")], "certification_type string")

    def kept(kind):
        return {r[0] for r in df.filter(search.all_of([search.certification(kind)])).collect()}

    assert kept("WBE") == {"WBE", "Non-MWBE", "MBE/WBE"}
    assert kept("MBE") == {"MBE", "MBE/WBE"}
    assert kept("Any MWBE") == {"MBE", "WBE", "MBE/WBE"}
    assert kept("Non-MWBE") == {"Non-MWBE"}
    assert len(kept("other")) == 6


def test_optional_conditions(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "s string, t string")
    assert df.filter(search.all_of([None, search.equals("s", ""), search.partial("t", None)])).count() == 2
    assert rows(df.filter(search.all_of([search.equals("s", "a"), search.matches_any(["s", "t"], "X")]))) == [("a", "x")]


def test_clamps():
    assert search.allowed(37, search.LEDGER_PAGE_SIZES, 20) == 20
    assert search.allowed(50, search.LEDGER_PAGE_SIZES, 20) == 50
    assert search.capped(500, 200) == 200
    assert search.allowed("Nope", search.BUSINESS_CATEGORIES) is None


@pytest.mark.parametrize("page, ids", [(-3, [1, 2]), (0, [1, 2]), (1, [1, 2]), (2, [3, 4]), (3, [5]), (4, [])])
def test_pages_cover_everything_once(spark, page, ids):
    df = spark.range(1, 6).toDF("id")
    order = search.sort_order({"id": "id"}, "nope", "id", "asc", [])
    shown = search.with_totals(search.page_rows(df, order, page, 2), df, 2)
    assert [r["id"] for r in shown.collect()] == ids
    assert {(r["total_rows"], r["total_pages"]) for r in shown.collect()} <= {(5, 3)}


@pytest.mark.parametrize("page, ids, more", [(1, [5, 4], True), (2, [3, 2], True), (3, [1], False)])
def test_look_ahead(spark, page, ids, more):
    got = search.page_with_next(spark.range(1, 6).toDF("id"), [F.desc("id")], page, 2).orderBy(F.desc("id")).collect()
    assert [r["id"] for r in got] == ids
    assert {r["has_next"] for r in got} == {more}


def test_numeric_aware_sort(spark):
    df = spark.createDataFrame([("$1,200",), ("30 days",), ("Zeta",), ("alpha",), ("-",), ("$-5",)], "c string")
    assert [r[0] for r in df.orderBy(*search.numeric_aware("c")).collect()] == ["$-5", "30 days", "$1,200", "-", "alpha", "Zeta"]


def test_vendor_pages_agree(views):
    """The pages of a sorted list, put together, are the list."""
    from tenderlake.operators.linkage import match_entities

    matched = match_entities(views.entities(), views.vendors())

    def page(n, **kw):
        return pages.vendors_page(views.vendors(), views.contracts(), matched, views.digital(), page=n, **kw).collect()

    got = [r["passport_supplier_id"] for n in (1, 2, 3) for r in page(n)]
    every = {r[0] for r in views.vendors().select("passport_supplier_id").collect()}
    assert len(got) == len(set(got)) == len(every) and set(got) == every
    by_name = {r["passport_supplier_id"]: (r["contract_count"], r["total_awarded"]) for n in (1, 2, 3) for r in page(n)}
    by_amount = {r["passport_supplier_id"]: (r["contract_count"], r["total_awarded"])
                 for n in (1, 2, 3) for r in page(n, sort="amount", order="desc")}
    assert by_name == by_amount
    linked = [len(page(1, linked=x)) and page(1, linked=x)[0]["total_rows"] for x in ("yes", "no")]
    assert sum(linked) == len(every)
    assert page(1, tag="Digital")[0]["total_rows"] < len(every)
    assert page(1, category="not a category")[0]["total_rows"] == len(every)
