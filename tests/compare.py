"""Spark-vs-DuckDB comparison used by the tests and by hand (python -m tests.compare)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return int(v)
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def frame_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    res = {"query": name, "rows": len(spdf), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    dpdf = con.execute(sql).df()
    res["duck_rows"] = len(dpdf)
    if sorted(spdf.columns) != sorted(dpdf.columns):
        res["status"] = f"COLUMNS {sorted(set(spdf.columns) ^ set(dpdf.columns))}"
        return res
    a, b = frame_rows(spdf), frame_rows(dpdf)
    if a == b:
        res["status"] = "ok"
    else:
        res["status"] = "MISMATCH"
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res["example"] = diffs if len(a) == len(b) else (len(a), len(b))
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from txnlens.session import local_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2].split(",")) if len(argv) > 2 else None
    spark = local_session(8)
    con = duck(sf)
    qs, osql = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, osql.get(name), sf, con)
        except Exception as e:  # noqa: BLE001
            r = {"query": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
