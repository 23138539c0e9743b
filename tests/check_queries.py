"""Run registered queries beside their SQL: ``python tests/check_queries.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from teleskein.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canon(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def compare(rows, columns, con, sql) -> str:
    """Empty text where the two results are the same bag of rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} vs {sorted(names)}"
    order = sorted(columns)
    left = Counter(tuple(_canon(r[c]) for c in order) for r in rows)
    at = [names.index(c) for c in order]
    right = Counter(tuple(_canon(r[i]) for i in at) for r in result.fetchall())
    if left == right:
        return ""
    only_left, only_right = left - right, right - left
    return f"{sum(only_left.values())} only Spark e.g. {next(iter(only_left), None)}; {sum(only_right.values())} only SQL e.g. {next(iter(only_right), None)}"


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", os.environ.get("CHECK_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='teleskein-check-')}",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            rows = df.collect()
            verdict = compare(rows, df.columns, con, sql[name]) if name in sql else "no SQL"
        except Exception as error:  # report and go on with the next query
            rows, verdict = [], f"ERROR {str(error)[:600]}"
        bad += verdict not in ("", "no SQL")
        print(f"{name:32s} {len(rows):8d} rows {time.time() - begin:6.2f}s {verdict or 'ok'}", flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
