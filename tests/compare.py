"""Run registered queries against their SQL in DuckDB: `python tests/compare.py SF [query ...]`."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs between a DataFrame and a statement, None if nothing does."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected, got = cur.fetchall(), [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(expected):
        return f"rows {len(got)} / {len(expected)}"
    for a, b in zip(_rows(df.columns, got), _rows(names, expected)):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(names)}: {a} / {b}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tenderlake.session import build_session

    folder, wanted = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            text = difference(query(spark, folder), con, sql[name]) if name in sql else f"no SQL, {query(spark, folder).count()} rows"
        except Exception as e:
            text = f"{type(e).__name__}: {str(e)[:600]}"
        bad += text is not None
        print(f"{'ok ' if text is None else 'BAD'} {name} {time.time() - start:.1f}s {text or ''}", flush=True)
    print("unmatched SQL:", set(sql) - set(entry.queries()), "bad:", bad)


if __name__ == "__main__":
    main()
