"""Compare registered queries with their SQL: python -m workload.check [sf] [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from workload.oracle import oracle_sql
from workload.queries import QUERIES
from workload.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "HUGEINT": "hugeint"}


def _normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__ == "float64":
            return repr(round(float(v), 9)) if v != int(v) else str(int(v))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False, name=None))


def compare(spark, db, name: str, sf_dir: str) -> str:
    """'ok', or what differs."""
    frame, relation = QUERIES[name](spark, sf_dir), db.sql(oracle_sql()[name])
    ours = dict(frame.dtypes)
    theirs = {n: TYPES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    types = {n: (ours[n], theirs.get(n)) for n in ours if ours[n] != theirs.get(n)}
    got, want = frame.toPandas(), relation.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = _normal(got), _normal(want)
    if a == b:
        return f"ok {len(a)}" + (f" but types differ: {types}" if types else "")
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return (f"DIFF rows {len(a)} vs {len(b)}; only spark {len(only_a)} {str(only_a[:2])[:600]}; "
            f"only sql {len(only_b)} {str(only_b[:2])[:600]}")


def database(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(QUERIES)
    spark, db = local_session("check"), database(sf_dir)
    for name in names:
        started = time.time()
        print(f"== {name}", file=sys.stderr, flush=True)
        try:
            result = compare(spark, db, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            result = f"FAIL {type(e).__name__}: {str(e)[:700]}"
        print(f"{name:28} {time.time() - started:6.1f}s {result}", flush=True)
    missing = set(QUERIES) ^ set(oracle_sql())
    print("without counterpart:", sorted(missing))


if __name__ == "__main__":
    main()
