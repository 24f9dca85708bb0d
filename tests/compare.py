"""Runs registered queries next to their SQL.

    python tests/compare.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if value is not None and type(value).__name__ == "Decimal":
        return round(float(value), 9)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql):
    """None if both give the same rows, else a short account."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    want = canonical(names, expected.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return None
    extra = [r for r in got if r not in set(want)][:2]
    lacking = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} vs {len(want)} rows; only Spark {extra}; only SQL {lacking}"[:1500]


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = database(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                result = "ok" if problem is None else "DIFF " + problem
            else:
                result, problem = f"rows {df.count()}", None
        except Exception as e:  # noqa: BLE001
            problem = result = f"ERROR {type(e).__name__} {str(e)[:900]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
