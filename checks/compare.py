"""Compare the checked queries with their DuckDB texts: rows, columns, values.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter

import duckdb

from .derived import BASE
from .queries import ORACLES, QUERIES
from .session import local_session


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if not isinstance(value, int) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def type_notes(df, description) -> str:
    theirs = {d[0]: str(d[1]) for d in description}
    notes = [f"{n} {t}/{theirs.get(n)}" for n, t in df.dtypes if n in theirs and TYPES.get(t, t) != theirs[n]]
    return "  types: " + ", ".join(notes) if notes else ""


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    bad = []
    for name in names:
        try:
            start = time.time()
            df = QUERIES[name](spark, sf)
            got = df.collect()
            took = time.time() - start
            line = f"{name:26s} {len(got):7d} rows {took:6.2f}s"
            if name in ORACLES:
                start = time.time()
                cur = con.execute(ORACLES[name])
                columns = [d[0] for d in cur.description]
                want = cur.fetchall()
                a, b = rows_of(df.columns, got), rows_of(columns, want)
                same = sorted(df.columns) == sorted(columns) and a == b
                line += f"  duckdb {time.time() - start:5.2f}s  {'ok' if same else 'DIFFERENT'}"
                line += type_notes(df, cur.description)
                if not want:
                    line += " (empty)"
                if not same:
                    bad.append(name)
                    line += f"\n   columns {sorted(df.columns)}\n           {sorted(columns)}\n   rows {len(got)} / {len(want)}"
                    for label, extra in (("spark", a - b), ("duckdb", b - a)):
                        for row in list(extra)[:3]:
                            line += f"\n   only {label}: {row}"
            else:
                line += "  (rows only)"
        except Exception as exc:
            bad.append(name)
            line = f"{name:26s} ERROR {str(exc)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        print(line, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main([a for a in sys.argv[1:] if a != "-v"]))
