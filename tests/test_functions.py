from pyspark.sql import functions as F

from tenderlake.functions import dates, keys, money, text


def test_keys(values):
    assert values(keys.normalized_key("x"), ["ct1-846-2023 8x", None, "", "---"]) == ["CT184620238X", None, None, ""]
    assert values(keys.comparable_name("x"), [None, "", "Acme, Inc."]) == ["", "", "ACMEINC"]
    assert values(keys.compact_key("x"), ["ct1-8 4", None]) == ["CT184", ""]
    assert values(keys.hyphenless_upper("x"), ["a-b c"]) == ["AB C"]
    assert values(keys.leading_segment("x"), ["CT1-846", "CT1"]) == ["CT1", "CT1"]
    assert values(keys.year_in_id("x"), ["CT1-846-20238001", "ABCDEF"]) == ["2023", "ABCD"]
    assert values(keys.base_key("x"), ["85826Y1251001", "858"]) == ["85826Y1251", "858"]
    assert values(keys.zero_pad("x", 3), ["7", "1234"]) == ["007", "1234"]


def test_patterns(values):
    assert values(keys.fallback_pattern("x"), ["ACME CORP", "ACMEWORKS", "ACME", "A CORP INC"]) == [
        "ACME%", "ACMEWORKS%", None, "A% INC"]
    assert values(keys.longest_literal("x"), ["ab%cdef_g", "%%", "plain"]) == ["cdef", "", "plain"]
    assert values(keys.contains_text("x", "a\\b"), ["xA\\By", "ab"]) == [True, False]
    assert values(keys.contains_text("x", "50%"), ["a 50", "5 0"]) == [True, False]
    assert values(keys.contains_text("x", "a_b"), ["AxB", "ab"]) == [True, False]
    assert values(keys.like("x", F.lit("A%")), ["ABC", "abc"]) == [True, False]
    assert values(keys.contained_either_way("x", F.lit("abc")), ["b", "xabcx", "d"]) == [True, True, False]


def test_money(values):
    given = ["$1,234.50", "(5)", "-5", None, "", "N/A", ".", "1.2.3", "5."]
    assert values(money.clean_money("x"), given) == [1234.5, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0]
    assert values(money.amount_value("x"), ["12.5", "N/A", "5d", "5 f", "-1e2", None]) == [12.5, None, None, None, -100.0, None]
    assert values(money.amount("x").cast("string"), ["12.5", "N/A", "5d"]) == ["12.50", None, None]
    assert values(money.currency_text("x"), [1234.5, None, -5.0], "double") == ["$1,234.50", "N/A", "$-5.00"]
    assert values(money.count_text("x"), [1234567], "long") == ["1,234,567"]
    assert values(money.percent_text("x"), [12.34], "double") == ["12.3%"]
    assert values(money.millions_text("x"), [2_500_000.0], "double") == ["$2.5M"]
    assert values(money.billions("x"), [1_234_000_000.0], "double") == [1.23]


def test_exact_sum_and_average(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    row = df.agg(money.exact_sum("x"), money.exact_avg("x")).first()
    assert tuple(row) == (0.3, 0.15)
    empty = df.filter("x > 9").agg(money.exact_sum("x"), money.exact_avg("x")).first()
    assert tuple(empty) == (None, None)


def test_dates(values):
    given = ["7/4/2024", "07/04/2024 12:00:00 AM", "2024-07-04", "", None, "13/45/2024", "bad"]
    assert values(dates.parse_mdy("x").cast("string"), given) == ["2024-07-04", "2024-07-04", None, None, None, None, None]
    assert values(dates.parse_any("x").cast("string"), given) == [
        "2024-07-04", "2024-07-04", "2024-07-04", None, None, None, None]
    assert values(dates.fiscal_year(dates.parse_mdy("x")), ["06/30/2024", "07/01/2024", "12/31/2024", "bad"]) == [2024, 2025, 2025, None]
    assert values(dates.strip_midnight("x"), ["01/02/2024 12:00:00 AM"]) == ["01/02/2024"]
    assert values(dates.iso_to_mdy_text("x"), ["2024-07-04", "2024-07-04T00:00", "2024"]) == ["07/04/2024", "07/04/2024", "2024"]
    assert values(dates.month_key(dates.parse_any("x")), ["7/4/2024"]) == ["2024-07"]


def test_fiscal_window(spark):
    df = spark.createDataFrame([(2019, 2022), (2024, 2030), (2024, None), (None, None)], "s int, e int")
    first, last = dates.fiscal_window(F.col("s"), F.col("e"), F.lit(2026), 5, F.lit(2025))
    assert [tuple(r) for r in df.select(first, last).collect()] == [(2018, 2024), (2023, 2025), (2023, 2025), (2020, 2025)]
    first, last = dates.fiscal_window(F.col("s"), F.col("e"), F.lit(2026), 0, F.lit(2025))
    assert tuple(df.filter("s is null").select(first, last).first()) == (2025, 2025)
    first, last = dates.fiscal_window(F.col("s"), F.col("e"), F.lit(2026), 5)
    assert [tuple(r) for r in df.select(first, last).collect()] == [(2018, 2024), (2023, 2026), (2023, 2026), (2021, 2026)]


def test_next_daily_run(values):
    run = F.date_format(dates.next_daily_run(F.col("x").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")
    assert values(run, ["2024-01-31 01:59:59", "2024-01-31 02:00:00", "2024-01-31 15:00:00"]) == [
        "2024-01-31 02:00", "2024-02-01 02:00", "2024-02-01 02:00"]


def test_text(values):
    assert values(text.or_default("x", "N/A"), ["a", "", None]) == ["a", "N/A", "N/A"]
    assert values(text.key_label("x"), ["prime_contract_type"]) == ["Prime Contract Type"]
    assert values(text.year_label("x"), ["fy2016"]) == ["2016"]
    assert values(text.truncated("x", 3), ["abcdef", "a"]) == ["abc", "a"]
    assert values(text.json_map("x")["a"], ['{"a": "1"}', "{bad", None]) == ["1", None, None]
    assert values(F.size(text.json_map("x")), ['{"a": "1", "b": 2}', "{bad", None]) == [2, 0, 0]
    html = "<style>p{}</style><script>x</script><p>A &amp; B</p><!-- no -->\n<b>c</b>"
    assert values(text.plain_text("x"), [html]) == ["A & B c"]


def test_front_matter(values):
    post = "Title: One: two\r\nDate: 2024-01-01\r\nno colon\nTITLE: Last\n\nBody: text\n\nmore"
    meta = text.front_matter("x")
    assert values(text.front_value(meta, "title"), [post]) == ["Last"]
    assert values(text.front_value(meta, "date"), [post, "\nTitle: late"]) == ["2024-01-01", None]
    assert values(text.post_body("x"), [post, "no blank line"]) == ["Body: text\n\nmore", "no blank line"]
    assert values(text.excerpt(text.front_value(meta, "excerpt"), F.lit("z" * 300)), ["Excerpt: short\n\nb", "a\n\nb"]) == [
        "short", "z" * 200 + "..."]
