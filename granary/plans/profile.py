"""Catalog profile: what the columns of many tables hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from granary.operators.catalog import (
    BINARY_TYPES, Tables, binary_columns, catalog_type_map, columns_by_type, convert_timestamps,
    table_list,
)


@dataclass(frozen=True)
class CatalogProfile:
    columns: DataFrame
    binary: DataFrame
    type_map: DataFrame
    converted: Tables


def profile_catalog(
    tables: Tables, types: tuple[str, ...], names: str | None = None,
    zone: str = "America/New_York",
) -> CatalogProfile:
    """Columns of the given types, 0/1 columns, target types, and tables in instants."""
    chosen = None if names is None else table_list(names)
    picked = {n: df for n, df in tables.items() if chosen is None or n in chosen}
    return CatalogProfile(
        columns_by_type(picked, types),
        binary_columns(picked, BINARY_TYPES),
        catalog_type_map(picked),
        convert_timestamps(tables, names, zone),
    )
