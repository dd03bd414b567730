"""Compare registered queries with their SQL counterparts in DuckDB.

Run as a script: ``python tests/oracle.py <sf_dir> [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(value: str) -> str:
    """One name for the types of both engines."""
    value = value.lower()
    return {"integer": "int", "varchar": "string", "boolean": "bool"}.get(value, value)


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def _clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result, ignoring the order of rows and columns."""
    relation = con.sql(sql)
    ours = {c: _kind(t) for c, t in df.dtypes}
    theirs = {c: _kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} and {sorted(theirs)}"]
    found = [f"type of {c}: {ours[c]} and {theirs[c]}" for c in ours if ours[c] != theirs[c]]
    columns = sorted(ours)
    a = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    order = [relation.columns.index(c) for c in columns]
    b = sorted((tuple(_clean(r[i]) for i in order) for r in relation.fetchall()), key=_key)
    if len(a) != len(b):
        found.append(f"rows {len(a)} and {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}")
    if not a:
        found.append("no rows")
    return found


def main() -> None:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            found = differences(df, con, oracles[name]) if name in oracles else [f"rows {df.count()}"]
        except Exception as failure:
            found = [f"{type(failure).__name__}: {str(failure)[:700]}"]
        mark = "ok  " if not found else ("rows" if name not in oracles else "FAIL")
        print(f"{mark} {name} {time.time() - start:.1f}s {'; '.join(found)}", flush=True)


if __name__ == "__main__":
    main()
