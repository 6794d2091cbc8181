"""Run registered queries beside their SQL and compare rows, columns and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value


def rows_of(records, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in order) for r in records]

    def place(row):
        # Keys first, measures last, so that a last digit never moves a row.
        keys = tuple((v is not None, str(type(v)), str(v)) for v in row if not isinstance(v, float))
        return keys, tuple((v is not None, str(type(v)), str(v)) for v in row)

    return sorted(rows, key=place)


def agree(a, b, exact: bool) -> bool:
    """Equal, or, unless exact, one unit of the last kept digit apart: two engines may round a tie apart."""
    if a == b:
        return True
    return not exact and isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-6)


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def compare(spark, con, name: str, sf: str, queries, oracles, exact: bool = False) -> str | None:
    """None if both sides agree, else what differs."""
    df = queries[name](spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if name not in oracles:
        return None if got else "no rows"
    rel = con.sql(oracles[name])
    want = rows_of(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if not got:
        return "no rows"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[0]}, want {want[:1]}"
    cols = sorted(df.columns)
    for i, c in enumerate(cols):
        kinds = {kind(r[i]) for r in got if r[i] is not None}, {kind(r[i]) for r in want if r[i] is not None}
        if kinds[0] != kinds[1]:
            return f"type of {c}: {kinds}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(agree, g, w, [exact] * len(g)))]
    if bad:
        diff = [c for i, c in enumerate(cols) if any(not agree(g[i], w[i], exact) for g, w in bad)]
        return f"{len(bad)} of {len(got)} rows differ in {diff}; got {bad[0][0]}, want {bad[0][1]}"
    return None


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from moodloom.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                     "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, sf, queries, oracles, exact=True)
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += result is not None
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if result is None else 'FAIL'} {name}{note} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
