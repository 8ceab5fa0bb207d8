"""Compare a Spark result with its SQL counterpart, values and types."""

from __future__ import annotations

import duckdb
import pyarrow as pa

from granary.registry.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def kind(data_type: pa.DataType) -> str:
    if pa.types.is_large_string(data_type):
        return "string"
    if pa.types.is_timestamp(data_type):
        return "timestamp"
    return str(data_type)


def rows(table: pa.Table) -> list[str]:
    names = sorted(table.column_names)
    return sorted(repr(tuple(r[n] for n in names)) for r in table.select(names).to_pylist())


def differences(spark_table: pa.Table, oracle: pa.Table) -> list[str]:
    """What sets the two results apart; empty when they agree."""
    a = {f.name: kind(f.type) for f in spark_table.schema}
    b = {f.name: kind(f.type) for f in oracle.schema}
    out = [f"type {n}: spark {a.get(n)} sql {b.get(n)}" for n in sorted(a.keys() | b.keys()) if a.get(n) != b.get(n)]
    if a.keys() != b.keys():
        return out
    left, right = rows(spark_table), rows(oracle)
    if len(left) != len(right):
        out.append(f"rows: spark {len(left)} sql {len(right)}")
    odd = [(x, y) for x, y in zip(left, right) if x != y]
    if odd:
        out.append(f"{len(odd)} rows differ, first: spark {odd[0][0][:300]} sql {odd[0][1][:300]}")
    return out


def run_oracle(con: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    return con.execute(sql).to_arrow_table()
