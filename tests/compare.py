"""Compare registered queries with their SQL twins: ``compare.py <sf dir> [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from veilframe.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


SPENT: dict[str, float] = {}


def differences(spark, con, sf_dir: str, name: str) -> str | None:
    """What differs between the two results, or None."""
    start = time.time()
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((repr(tuple(r)) for r in df.select(*columns).collect()))
    SPENT[name] = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return f"columns {columns} <> {sorted(rel.columns)}"
    theirs = sorted(
        repr(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    )
    if ours == theirs:
        return None
    only = [x for x in ours if x not in set(theirs)][:1], [x for x in theirs if x not in set(ours)][:1]
    return f"rows {len(ours)} / {len(theirs)}; only here {only[0]}; only there {only[1]}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or contract.queries():
        start = time.time()
        try:
            diff = differences(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        has = name in contract.oracle_sql()
        print(f"{'FAIL' if diff else 'ok' if has else 'ran':5}{name:28}{SPENT.get(name, 0):6.2f}s"
              f" +{time.time() - start - SPENT.get(name, 0):5.2f}s"
              f"  {(diff or '')[:1500]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
