"""Compare a Spark result with a DuckDB result: names, types and sorted rows."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TESTDATA = "/root/testdata"
TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        path = os.path.join(TESTDATA, sf, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _sorted_rows(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Fail on any difference; return the number of rows."""
    relation = con.sql(sql)
    spark_types = {n: _TYPES.get(t, t) for n, t in result.dtypes}
    duck_types = {n: str(t) for n, t in zip(relation.columns, relation.types, strict=True)}
    assert spark_types == duck_types
    names = sorted(spark_types)
    ours = _sorted_rows([tuple(r) for r in result.select(*names).collect()])
    theirs = _sorted_rows([tuple(r) for r in relation.select(*[f'"{n}"' for n in names]).fetchall()])
    assert ours == theirs
    return len(ours)
