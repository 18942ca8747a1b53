"""Compare registered queries with DuckDB; also a command: python tests/oracle.py <sf> [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    # The type is part of the value: 1, 1.0 and Decimal(1) are not the same answer.
    return (type(v).__name__, v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(con, sql, df) -> str:
    got_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_cols, want_rows = rel.columns, rel.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    got, want = rows_of(df.columns, got_rows), rows_of(want_cols, want_rows)
    if got == want:
        return ""
    extra = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else got[:1]
    missing = [r for r in want if r not in set(got)][:3] if len(want) < 50000 else want[:1]
    return f"{len(got)} rows vs {len(want)}; columns {sorted(df.columns)}; only spark {extra}; only oracle {missing}"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{argv[0]}"
    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                why = compare(con, oracles[name], df)
                state = "ok" if not why else "BAD " + why
            else:
                state = f"rows {df.count()} (no oracle)"
        except Exception as exc:  # noqa: BLE001 - shown to the reader
            state = "FAIL " + str(exc)[:1500]
        bad += state.startswith(("BAD", "FAIL"))
        print(f"{name:32s} {time.time() - start:6.1f}s {state}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
