"""Run registered queries against their DuckDB twins on a folder of driver tables."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=key)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, name, fn, sql, folder, con):
    """(ok, message)"""
    df = fn(spark, folder)
    got = df.collect()
    if sql is None:
        return len(got) >= 0, f"rows only: {len(got)}"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    for field in df.schema.fields:
        text, kind = field.dataType.simpleString(), kinds[field.name]
        good = {
            "bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "double": ("DOUBLE", "NUMBER"),
            "string": ("VARCHAR", "STRING"), "date": ("DATE", "Date"),
        }.get(text)
        if good and kind not in good:
            return False, f"type of {field.name}: {text} != {kind}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}; " + diff(a, b)
    if a != b:
        return False, diff(a, b)
    return True, f"{len(a)} rows"


def diff(a, b):
    sa, sb = set(a), set(b)
    left = sorted(sa - sb, key=key)
    right = sorted(sb - sa, key=key)
    return f"{len(left)} differ: spark {left[:2]} sql {right[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, str(pathlib.Path(__file__).parents[1]))
    import __spark_entry__ as entry
    from usageloom.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(8)
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, name, fn, oracle.get(name), folder, con)
        except Exception as exc:
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.2f}s {message}", flush=True)
    print("failed:", bad)
