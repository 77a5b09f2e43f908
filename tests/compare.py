"""Run registered queries beside their DuckDB SQL and compare every value.

    python -m tests.compare [directory] [name ...]
"""

from __future__ import annotations

import sys

import duckdb
import pandas as pd

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, sorted, NULL as None and ints as int."""
    columns = sorted(frame.columns)

    def plain(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return None
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, float) and value == int(value):
            return int(value)
        return value

    rows = [tuple(plain(v) for v in row) for row in frame[columns].astype(object).values.tolist()]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(spark, con, name: str, folder: str) -> str | None:
    """None when both engines give the same rows, else the first difference."""
    mine = entry.queries()[name](spark, folder).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    types = {
        c: (mine[c].dtype, theirs[c].dtype)
        for c in mine.columns
        if mine[c].dtype != theirs[c].dtype and not {"O", "U"} & {mine[c].dtype.kind}
    }
    left, right = canonical(mine), canonical(theirs)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        return f"{len(unequal)} of {len(left)} rows differ, first {unequal[0]}"
    return f"types differ: {types}" if types else None


def main() -> int:
    from tests.conftest import new_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, failed = new_session(), duck(folder), 0
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        try:
            problem = difference(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        if problem:
            print(f"{name}: {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal in {folder}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
