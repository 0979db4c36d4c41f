from conftest import rows
from tenderlake.sources import feeds, ledger
from tenderlake.streaming import ledger_stream

COLUMNS = ["payee_name", "check_amount", "issue_date"]
SCHEMA = feeds.text_schema(COLUMNS)


def _drop(spark, path, data):
    ledger.write_csv(spark.createDataFrame(data, SCHEMA), path)


def test_two_drops_equal_one_load(spark, tmp_path):
    landing, target, state = (str(tmp_path / x) for x in ("landing", "ledger", "state"))
    first = [("a", "1.00", "2024-06-30"), ("a", "N/A", "2024-07-01")]
    second = [("b", "2.00", "07/04/2024"), ("b", "4.00", "bad")]

    def run():
        assert ledger_stream.ingest(spark, landing, target, state, schema=SCHEMA, timeout=120)
        return rows(spark.read.parquet(target).select(*COLUMNS, "fiscal_year"))

    _drop(spark, landing, first)
    once = run()
    assert once == [("a", "1.00", "2024-06-30", 2024), ("a", "N/A", "2024-07-01", 2025)]
    assert run() == once
    _drop(spark, landing, second)
    assert run() == sorted([*once, ("b", "2.00", "07/04/2024", 2025), ("b", "4.00", "bad", 0)], key=repr)


def test_monthly_rollup_follows_and_repeats_safely(spark, tmp_path):
    landing, target, state = (str(tmp_path / x) for x in ("landing", "months", "state"))

    def run():
        assert ledger_stream.maintain_monthly(spark, landing, target, state, schema=SCHEMA, timeout=120)
        return rows(ledger_stream.read_monthly(spark, target))

    _drop(spark, landing, [("a", "1.00", "2024-06-30"), ("a", "N/A", "2024-06-01")])
    assert run() == [("2024-06", 1.0, 2)]
    _drop(spark, landing, [("a", "2.00", "2024-06-15"), ("a", "4.00", "2024-07-15")])
    assert run() == [("2024-06", 3.0, 3), ("2024-07", 4.0, 1)]
    assert run() == [("2024-06", 3.0, 3), ("2024-07", 4.0, 1)]


def test_xml_pages_stream(spark, tmp_path):
    landing, target, state = (str(tmp_path / x) for x in ("landing", "ledger", "state"))
    (tmp_path / "landing").mkdir()
    page = "<r><transaction><payee_name>a</payee_name><check_amount>1</check_amount><issue_date>2024-01-05</issue_date></transaction></r>"
    (tmp_path / "landing" / "p1.xml").write_text(page)
    assert ledger_stream.ingest(spark, landing, target, state, fmt="xml", schema=SCHEMA, timeout=120)
    assert rows(ledger.read_ledger(spark, target)) == [("a", "1", "2024-01-05", 2024)]
