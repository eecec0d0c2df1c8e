"""Compare registered queries with their SQL on one data folder: python tests/check_oracles.py [folder] [name ...]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and not hasattr(v, "__len__") and pd.isna(v)):
            return "~"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (bool,)):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6f}"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def compare(spark, con, name, query, sql, folder) -> str:
    t0 = time.time()
    mine = query(spark, folder).toPandas()
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(mine):>8} rows {took:6.1f}s"
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"FAIL columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if a != b:
        extra, missing = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"FAIL {len(a)} vs {len(b)} rows; {sorted(mine.columns)} extra {extra} missing {missing}"
    return f"ok        {len(a):>8} rows {took:6.1f}s"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            verdict = compare(spark, con, name, query, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            verdict = "FAIL " + f"{type(e).__name__}: {e}"[:700]
        bad += verdict.startswith("FAIL")
        print(f"{name:32} {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
