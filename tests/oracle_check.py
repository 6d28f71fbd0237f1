"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def compare(df, db, sql) -> str:
    """Empty text when rows, column names, types and values agree."""
    relation = db.execute(sql)
    described = {d[0]: str(d[1]) for d in relation.description}
    found = relation.fetchall()
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(spark_types) != sorted(described):
        return f"columns {sorted(spark_types)} / {sorted(described)}"
    for name, kind in spark_types.items():
        if KINDS.get(kind, kind) != described[name]:
            return f"type of {name}: {kind} / {described[name]}"
    mine = rows_of(df.columns, df.collect())
    theirs = rows_of(list(described), found)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"values\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return "" if mine else "no rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from dossier.session import local_session

    spark = local_session()
    folder = f"/root/testdata/sf{args.sf}"
    db = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    chosen = [n for n in queries if not args.names or any(a in n for a in args.names)]
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            problem = compare(df, db, oracle[name]) if name in oracle else f"rows only: {df.count()}"
            if name not in oracle:
                print(f"     {name:38s} {time.time() - start:6.2f}s {problem}", flush=True)
                continue
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '}  {name:38s} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
