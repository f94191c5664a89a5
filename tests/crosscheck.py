"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return repr(v)


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _kind(duck_type: str) -> str:
    names = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}
    return names.get(str(duck_type), str(duck_type))


def compare(spark, con, sf_dir, fn, sql) -> list[str]:
    """Differences between a query and its SQL: columns, types, rows. Empty when equal."""
    df = fn(spark, sf_dir)
    mine, my_rows = _normal(df.columns, df.collect())
    rel = con.sql(sql)
    theirs, their_rows = _normal(rel.columns, rel.fetchall())
    problems = []
    if mine != theirs:
        return [f"columns {mine} against {theirs}"]
    my_types = dict(df.dtypes)
    for c, t in zip(rel.columns, rel.types):
        if my_types[c] != _kind(t):
            problems.append(f"type of {c}: {my_types[c]} against {t}")
    if len(my_rows) != len(their_rows):
        problems.append(f"{len(my_rows)} rows against {len(their_rows)}")
    a, b = set(my_rows), set(their_rows)
    if my_rows != their_rows:
        problems.append(f"values: {sorted(a - b)[:3]} against {sorted(b - a)[:3]} in {mine}")
    return problems


if __name__ == "__main__":
    import sys

    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from headcount.session import local_session

    spark = local_session()
    import os

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf)
    oracle = e.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for key, fn in e.queries().items():
        if (wanted and key not in wanted) or key not in oracle:
            continue
        start = time.time()
        try:
            found = compare(spark, con, sf, fn, oracle[key])
        except Exception as ex:  # report and go on
            found = [f"{type(ex).__name__}: {str(ex)[:700]}"]
        bad += bool(found)
        print(f"{'ok  ' if not found else 'DIFF'} {key} {time.time() - start:.1f}s", *found, sep="\n    " if found else " ", flush=True)
    print("differences:", bad)
