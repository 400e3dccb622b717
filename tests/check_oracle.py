"""Run the named queries next to DuckDB and compare rows.

    python tests/check_oracle.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from lakepipe.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
FAMILIES = {
    "bigint": "long", "long": "long", "integer": "int", "int": "int", "varchar": "string", "string": "string",
    "double": "double", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date",
    "hugeint": "hugeint", "float": "float",
}


def family(name: str) -> str:
    return FAMILIES.get(name.lower(), name.lower())


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    spark_types = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {d[0]: family(str(d[1])) for d in cursor.description}
    wrong = {c: (spark_types[c], duck_types[c]) for c in columns if spark_types[c] != duck_types[c]}
    places = [names.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in places) for r in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}; types {wrong}"
    left, right = sorted(ours), sorted(theirs)
    differ = [(a, b) for a, b in zip(left, right) if a != b]
    if differ:
        return f"{len(differ)} of {len(ours)} rows differ, first {columns}: {differ[0]}; types {wrong}"
    return f"types {wrong}" if wrong else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(args.sf), oracle_sql(), 0
    for name, run in queries().items():
        if args.names and name not in args.names:
            continue
        started = time.time()
        try:
            df = run(spark, args.sf)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                kind = "ok"
            else:
                problem, kind = None, f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem, kind = f"{type(error).__name__}: {str(error)[:600]}", "error"
        failed += problem is not None
        print(f"{'FAIL' if problem else kind:10s} {name:32s} {time.time() - started:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
