"""Deep pages, latest rows, masked keys, short names, folded months and paged sources against plain counterparts."""

import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tenderlake.functions import text
from tenderlake.operators import linkage, search
from tenderlake.operators.ranking import cut_days, latest_per_group
from tenderlake.sources import feeds, ledger, paged
from tenderlake.streaming import ledger_stream


def _cells(spark, n=1500, seed=1):
    rng = random.Random(seed)
    data = [(
        i, rng.choice([None, "", "a", "ab", "abc", "abcd", "b" * 9]) if rng.random() < 0.7 else "hot",
        rng.choice([None, 1.5, 2.5, float("nan")]) if rng.random() < 0.5 else rng.random(), rng.choice(["2024-01-01", "2024-01-02", None])) for i in range(n)]
    return spark.createDataFrame(data, "id long, name string, amount double, day string").repartition(4).cache()


@pytest.mark.parametrize("keys", [
    [("name", True), ("amount", False), ("id", True)], [("amount", True), ("id", False)], [("amount", False), ("name", False), ("id", True)]])
def test_deep_pages_equal_the_whole_order(spark, keys):
    df = _cells(spark)
    want = [r.id for r in df.orderBy(*search.by_keys(keys)).collect()]
    for page in (2, 30):
        got = search.page_at(df, keys, page, 50, few=40)
        assert [r.id for r in got.collect()] == want[(page - 1) * 50:page * 50], page
    assert search.page_at(df, keys, 31, 50, few=40).count() == 0
    ahead = search.page_at_with_next(df, keys, 30, 50, few=40).collect()
    assert sorted(r.id for r in ahead) == sorted(want[-50:]) and not any(r.has_next for r in ahead)
    assert all(r.has_next for r in search.page_at_with_next(df, keys, 29, 50, few=40).collect())


def test_a_deep_page_starts_near_its_place(spark):
    df = spark.range(0, 200_000, numPartitions=8).withColumn("day", F.date_add(F.to_date(F.lit("2010-01-01")), (F.col("id") % 5000).cast("int")).cast("string"))
    keys = [("day", False), ("id", True)]
    found, skip = search.narrowed(df, keys, 150_000, 20, few=100)
    assert skip <= 100 and found.count() < 60_000
    assert [r.id for r in search.page_at(df, keys, 7501, 20, few=100).collect()] == [
        r.id for r in df.orderBy(*search.by_keys(keys)).offset(150_000).limit(20).collect()]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_latest_rows_equal_brute_force(spark, n):
    rng = random.Random(n)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["2024-01-01", "2024-01-02", "2024-02-01", None]), i % 50) for i in range(400)]
    df = spark.createDataFrame(data, "g string, day string, x int")
    want = defaultdict(list)
    for g, day, x in sorted(data, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[2])):
        want[g].append((g, day, x))
    got = latest_per_group(df, "g", "day", [F.col("x")], n).drop("rank")
    assert rows(got) == sorted([r for g in want.values() for r in g[:n]], key=repr)
    cuts = {r.g: r._cut for r in cut_days(df.groupBy("g", "day").agg(F.count("*").alias("_n")), ["g"], "day", n).collect()}
    assert cuts == {g: (r[n - 1][1] if len(r) >= n else None) for g, r in want.items()}


def _like(text_, pattern):
    import re
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text_, re.S) is not None


def test_masked_pieces_equal_brute_force(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choice("0aB_") for _ in range(rng.randint(3, 11))) for _ in range(300)] + ["0000000000", "00_0"]
    pins = ["".join(rng.choice("00aB__%-") for _ in range(rng.randint(0, 10))) for _ in range(200)] + ["____", "0000_000", "_", "%", "12345678", None, "0_0_0_0_9"]
    notices = spark.createDataFrame([(str(i), p) for i, p in enumerate(pins)], "RequestID string, PIN string")
    solicitations = spark.createDataFrame([(k.upper(),) for k in keys], "normalized_epin string")
    want = [str(i) for i, p in enumerate(pins) if p is not None and any(_like(k.upper(), f"%{p.replace('-', '').upper()[:8]}%") for k in keys)]
    assert sorted(r.RequestID for r in linkage.partial_links(notices, solicitations).collect()) == sorted(want)


def test_one_common_literal_makes_no_pairs(spark):
    """All keys hold the literal of all patterns; masked windows are still few."""
    keys = spark.range(4000).select(F.concat(F.lit("0000"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("normalized_epin"))
    notices = spark.range(500).select(F.col("id").cast("string").alias("RequestID"), F.concat(
        F.lit("0000_"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("PIN")).withColumn(
            "PIN", F.when(F.col("RequestID").cast("int") % 5 == 0, F.replace("PIN", F.lit("_"), F.lit("_X"))).otherwise(F.col("PIN")))
    assert linkage.partial_links(notices, keys).count() == 400


@pytest.mark.parametrize("seed", range(2))
def test_short_names_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("ABC %_" if rng.random() < 0.2 else "ABC ") for _ in range(rng.randint(a, b)))
    names, payees = sorted({word(0, 12) for _ in range(60)}), sorted({word(0, 14) for _ in range(150)})
    got = linkage.names_containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in payees], "payee_name string"))
    assert rows(got) == sorted(((n, p) for n in names for p in payees if _like(p, f"%{n}%")), key=repr)


COLUMNS = ["check_amount", "issue_date"]


def test_months_fold_without_counting_twice(spark, tmp_path):
    landing, rollup, state = (str(tmp_path / x) for x in ("landing", "months", "state"))
    schema, total = feeds.text_schema(COLUMNS), 0
    for k in range(14):
        ledger.write_csv(spark.createDataFrame([(f"{k}.00", "2024-06-15"), ("1.00", f"2024-{k % 3 + 1:02d}-01")], schema).coalesce(1), landing)
        total += k + 1
    assert ledger_stream.maintain_monthly(spark, landing, rollup, state, schema=schema, timeout=300, fold=4, files_per_trigger=1)
    months = lambda: {r.month: (r.total, r.tx_count) for r in ledger_stream.read_monthly(spark, rollup).collect()}
    want = months()
    assert sum(t for t, _ in want.values()) == total and sum(n for _, n in want.values()) == 28
    query = next((tmp_path / "months").iterdir())
    assert sorted(p.name for p in query.iterdir()) == ["batch=12", "batch=13", "upto=11"]
    # A batch that is repeated after its fold, a fold that is repeated, and one that broke before it was finished.
    spark.read.parquet(f"{query}/batch=12").write.parquet(f"{query}/batch=11")
    assert months() == want
    ledger_stream.fold_months(spark, str(query), 11)
    assert months() == want and not (query / "batch=11").exists()
    (query / "upto=13").mkdir()
    assert months() == want
    ledger_stream.fold_months(spark, str(query), 13)
    assert months() == want and sorted(p.name for p in query.iterdir()) == ["upto=13"]
    assert ledger_stream.read_monthly(spark, str(tmp_path / "nothing")).count() == 0


def test_pages_of_a_source(spark, tmp_path):
    schema = feeds.text_schema(["payee_name", "check_amount", "issue_date"])

    def add(k, n):
        table = pa.table({"payee_name": [f"p{k}-{i}" for i in range(n)], "check_amount": ["1.00"] * n, "issue_date": ["2024-01-05"] * n})
        pq.write_table(table, tmp_path / f"{k}.parquet", row_group_size=7)

    total, fetch = paged.parquet_pages(lambda: sorted(str(p) for p in tmp_path.glob("*.parquet")))
    source = paged.paged_source("test_pages", schema, total, fetch, limit=10)
    target, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    seen = []
    for k, n in enumerate((25, 0, 3, 18)):
        add(k, n)
        assert ledger_stream.ingest_stream(paged.stream_pages(spark, source), target, state, timeout=120)
        seen += [f"p{k}-{i}" for i in range(n)]
        assert sorted(r.payee_name for r in ledger.read_ledger(spark, target).collect()) == sorted(seen)
    assert paged.read_pages(spark, source).count() == 46
    assert [(p.offset, p.limit) for p in paged.pages(25, 46, 10)] == [(25, 10), (35, 10), (45, 1)]


def test_a_short_page_fails(spark):
    schema = feeds.text_schema(["a"])
    batch = pa.RecordBatch.from_arrays([pa.array(["x"])], names=["a"])
    source = paged.paged_source("short_pages", schema, lambda: 3, lambda offset, limit: iter([batch]), limit=2)
    with pytest.raises(Exception, match="rows instead of"):
        paged.read_pages(spark, source).collect()


def test_json_values(spark, values):
    inputs = ['{"a": {"n": 12345678901, "x": 1.5}, "b": [1]}', "{bad", None, "[1]"]
    value = text.json_value("x")
    assert values(text.json_path(value, "$.a.n", "bigint"), inputs) == [12345678901, None, None, None]
    assert values(text.json_path(value, "$.a.x", "double"), inputs) == [1.5, None, None, None]
    assert values(F.to_json(value), inputs)[1:3] == ["{}", "{}"]


def test_configured_ledger(spark, tmp_path):
    with pytest.raises(ValueError, match="ledger.local"):
        ledger.configured_ledger(spark)
    one = spark.createDataFrame([("a", 2024)], "payee_name string, fiscal_year int")
    ledger.write_ledger(one, str(tmp_path / "l"))
    spark.conf.set("spark.tenderlake.ledger.local", str(tmp_path / "l"))
    try:
        assert rows(ledger.configured_ledger(spark)) == [("a", 2024)]
        assert ledger.configured_ledger(spark, [2023]).count() == 0
    finally:
        spark.conf.unset("spark.tenderlake.ledger.local")


def test_adopted_files(spark, tmp_path):
    root = str(tmp_path / "other")
    spark.createDataFrame([("a", "x", 2024)], "payee_name string, old string, fiscal_year int").write.partitionBy("fiscal_year").parquet(root)
    spark.createDataFrame([("b", "y", 2025)], "payee_name string, new string, fiscal_year int").write.mode("append").partitionBy("fiscal_year").parquet(root)
    want = [("a", "x", None, 2024), ("b", None, "y", 2025)]
    read = lambda: rows(ledger.read_ledger(spark, root).select("payee_name", "old", "new", "fiscal_year"))
    assert read() == want
    ledger.adopt(spark, root)
    assert ledger._stored_schema(spark, root) is not None and read() == want
