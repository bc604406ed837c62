"""Compare a Spark result with a DuckDB result: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time(0) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns)] if columns else []
    return names, sorted(rows, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    got_names, got = _rows(spark_df.toArrow())
    want_names, want = _rows(con.sql(sql).to_arrow_table())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)} rows", f"got {got[:2]}", f"want {want[:2]}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(got)} rows differ", *[f"got  {g}\nwant {w}" for g, w in bad[:2]]] if bad else []
