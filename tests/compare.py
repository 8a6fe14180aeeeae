"""Run registered queries against DuckDB on the same files; exit code = number of mismatches.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(normal, value)) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL, {took:.1f}s"
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows, {took:.1f}s"
    only = [r for r in got[1] if r not in set(want[1])][:3]
    miss = [r for r in want[1] if r not in set(got[1])][:3]
    return False, (f"{len(got[1])} vs {len(want[1])} rows\n  columns {got[0]}\n          {want[0]}"
                   f"\n  spark {only}\n  sql   {miss}")


def main(argv):
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(argv[0]), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), argv[0])
        except Exception as exc:  # report and go on to the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
