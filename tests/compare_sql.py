"""Compares query results in Parquet with their SQL in DuckDB; a process of its own, apart from Spark's."""

import math
import os
import sys

import duckdb
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def main(sf: str, out: str) -> int:
    import __spark_entry__

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    for name, sql in __spark_entry__.oracle_sql().items():
        if not os.path.exists(f"{out}/{name}"):
            continue
        result = con.execute(sql)
        cols = [d[0] for d in result.description]
        order = sorted(cols)
        want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in result.fetchall()), key=repr)
        table = pq.read_table(f"{out}/{name}")
        if sorted(table.column_names) != order:
            print(name, "columns", table.column_names, cols)
            bad += 1
            continue
        got = sorted((tuple(plain(r[c]) for c in order) for r in table.to_pylist()), key=repr)
        if got != want:
            print(name, "differs", len(got), len(want), [x for x in zip(got, want, strict=False) if x[0] != x[1]][:2])
            bad += 1
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:3]))
