"""Compare a registered query with its DuckDB SQL on the same Parquet tables.

Columns are matched by name (sorted), rows compared as multisets after
normalising values (decimals and floats to fixed text, timestamps to ISO).
Usable from pytest and as a script: ``python tests/oracle_compare.py [sf_dir] [names...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value: object) -> object:
    if value is None:
        return None
    if isinstance(value, decimal.Decimal):
        return f"D{value:.6f}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"F{value:.9g}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    return str(value)


def _rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    normed = [tuple(_norm(r[i]) for i in order) for r in rows]
    return names, sorted(normed, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con: duckdb.DuckDBPyConnection | None = None) -> dict:
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    spark_cols = df.columns
    spark_rows = [tuple(r) for r in df.collect()]
    spark_sec = time.time() - t0
    result = {"name": name, "spark_rows": len(spark_rows), "spark_sec": round(spark_sec, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        result["oracle"] = "none"
        return result
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    duck_cols = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    s_names, s_vals = _rows(spark_cols, spark_rows)
    d_names, d_vals = _rows(duck_cols, duck_rows)
    result.update(
        oracle_rows=len(duck_rows),
        columns_match=s_names == d_names,
        values_match=s_vals == d_vals,
    )
    if not result["columns_match"]:
        result["spark_columns"], result["oracle_columns"] = s_names, d_names
    elif not result["values_match"]:
        diff = [(a, b) for a, b in zip(s_vals, d_vals) if a != b][:3]
        result["first_diffs"] = diff
    return result


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ledgerflow.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8, conf={"spark.ui.enabled": "false"})
    from __spark_entry__ import queries as _q

    names = sys.argv[2:] or list(_q())
    con = duck(sf)
    ok = True
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as exc:  # noqa: BLE001
            r = {"name": n, "error": f"{type(exc).__name__}: {str(exc)[:300]}"}
        good = r.get("values_match", r.get("oracle") == "none") and "error" not in r
        ok &= bool(good)
        print(("OK  " if good else "BAD ") + str(r), flush=True)
    sys.exit(0 if ok else 1)
