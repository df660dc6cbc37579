"""Run queries and their SQL side by side: python tests/compare.py [sf_dir] [name...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}")
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        return str(x) if x is not None and not isinstance(x, (int, bool, str)) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        at = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{at}')")
    return db


def compare(spark, name: str, run, sql: str | None, sf_dir: str, db) -> str:
    began = time.time()
    frame = run(spark, sf_dir)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - began
    if sql is None:
        return f"{name}: {len(mine)} rows, no SQL, {took:.1f}s"
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    other = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"{name}: COLUMNS {sorted(frame.columns)} {sorted(columns)}"
    if mine == other:
        return f"{name}: ok {len(mine)} rows, {took:.1f}s"
    a, b = [x for x in mine if x not in set(other)][:2], [x for x in other if x not in set(mine)][:2]
    return f"{name}: DIFFERS {len(mine)} {len(other)} spark {str(a)[:400]} sql {str(b)[:400]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lodestrata.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    found, oracles = entry.queries(), entry.oracle_sql()
    session, duckdb_ = local_session(8), duck(sf)
    for key in found:
        if not names or any(key.startswith(n) for n in names):
            try:
                print(compare(session, key, found[key], oracles.get(key), sf, duckdb_), flush=True)
            except Exception as wrong:  # noqa: BLE001
                print(f"{key}: ERROR {str(wrong)[:700]}", flush=True)
