"""Run queries next to their DuckDB SQL: python -m checks.compare [sf] [key prefix ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLES, QUERIES, TABLES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("colscope-checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float) and (math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def compare(spark, con, key: str, folder: str) -> tuple[bool, str]:
    df = QUERIES[key](spark, folder)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if key not in ORACLES:
        return True, f"rows only: {len(got)}"
    rel = con.execute(ORACLES[key])
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want_names, want = _rows([d[0] for d in rel.description], rel.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if [str(x) for x in g] != [str(x) for x in w]:
            bad = [(n, a, b) for n, a, b in zip(got_names, g, w) if str(a) != str(b)]
            return False, f"{len(got)} rows, first difference {bad[:3]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    off = [(n, t, want_types[n]) for n, t in df.dtypes if kinds.get(t, t) != want_types[n]]
    return True, f"{len(got)} rows" + (f" TYPES {off}" if off else "")


def main(argv) -> int:
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), database(folder)
    failed = []
    for key in QUERIES:
        if argv[1:] and not any(key.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, key, folder)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            failed.append(key)
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
