"""Run registered queries next to their SQL twins. Command line: oracle.py FOLDER [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(x):
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if x != x else f"{x:.9g}"
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(con, sql: str, df) -> str | None:
    """``None`` when both sides agree, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    cursor = con.execute(sql)
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{n}:{t}/{types[n]}" for n, t in df.dtypes if kinds.get(t) != types[n]]
    return f"types {odd}" if odd else None


def main(folder: str, *wanted: str) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failures = duck(folder), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                problem = compare(con, sqls[name], df)
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - began:6.2f}s {name}{'' if name in sqls else ' (rows only)'}"
              f"{'' if problem is None else ': ' + problem}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))
