"""Runs registered queries and their SQL on the same tables and compares the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

import math
import sys
import time

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lanewise")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data), [cols[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, gcols = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0, True
    cur = con.execute(sql)
    want, wcols = rows([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if gcols != wcols:
        return f"COLUMNS {gcols} != {wcols}", t1 - t0, t2 - t1, False
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        text = f"DIFF {len(got)} vs {len(want)}; {gcols}\n  only spark {len(extra)}: {extra[:3]}\n  only sql   {len(missing)}: {missing[:3]}"
        return text, t1 - t0, t2 - t1, False
    return f"ok {len(got)}", t1 - t0, t2 - t1, True


def main(argv):
    from checks.oracle import SQL
    from checks.queries import QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark, con = session(), duck(sf_dir)
    bad = []
    for name in names:
        try:
            text, ts, td, ok = compare(spark, con, QUERIES[name], SQL.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            text, ts, td, ok = f"ERROR {str(e)[:700]}", 0, 0, False
        if not ok:
            bad.append(name)
        print(f"{name:28s} {ts:6.2f}s {td:6.2f}s {text}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
