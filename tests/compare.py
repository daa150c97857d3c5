"""Run registered queries and their SQL side by side.

    python tests/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else a short account of how they differ."""
    frame = query(spark, sf_dir)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in result.description}
    spark_kinds = dict(frame.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}
    off = {c: (spark_kinds[c], kinds[c]) for c in names
           if same.get(spark_kinds[c], kinds[c]) != kinds[c]}
    ours, theirs = rows_of(frame.columns, frame.collect()), rows_of(names, result.fetchall())
    if off:
        return f"types {off}"
    if not ours:
        return "no rows"
    if ours != theirs:
        only_ours = [r for r in ours if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(ours)][:2]
        return f"{len(ours)} vs {len(theirs)} rows; {str(only_ours)[:700]} | {str(only_theirs)[:700]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from postmill.session import local_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, bad = local_session(8), connect(sf_dir), 0
    todo, sqls = queries(), oracle_sql()
    for key in args or todo:
        start = time.time()
        try:
            if key in sqls:
                verdict = difference(spark, con, todo[key], sqls[key], sf_dir) or "ok"
            else:
                verdict = f"rows only: {todo[key](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = f"ERROR {str(e)[:900]}"
        bad += not (verdict == "ok" or verdict.startswith("rows only"))
        print(f"{key:28s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{bad} of {len(args or todo)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
