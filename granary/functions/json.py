"""JSON and XML columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import camel_case


def rename_json(col: Column, schema: T.StructType, names: dict[str, str]) -> Column:
    """Project a JSON object on the mapped keys and write them under their new names."""
    parsed = F.from_json(col, schema)
    return F.to_json(F.struct(*[parsed[old].alias(new) for old, new in names.items()]))


def camel_json(columns: list[str]) -> Column:
    """A row as JSON, its keys in camelCase."""
    return F.to_json(F.struct(*[F.col(c).alias(camel_case(c)) for c in columns]))


def xml_as_json(col: Column, root: str, schema: T.StructType) -> Column:
    """XML document -> JSON object under its root name; a declaration is dropped."""
    body = F.from_xml(col, schema, {"mode": "FAILFAST"})
    return F.to_json(F.struct(body.alias(root)))


# JSON value kinds and the property types they stand for.
SHAPE_TYPES = {
    "STRING": "string",
    "BIGINT": "int",
    "DECIMAL": "double",
    "DOUBLE": "double",
    "BOOLEAN": "bool",
    "OBJECT": "object",
}


def shape_type(variant: Column) -> Column:
    """Property type of a JSON value; arrays and nulls are plain objects."""
    kind = F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)
    out = F.lit("object")
    for name, target in SHAPE_TYPES.items():
        out = F.when(kind == name, target).otherwise(out)
    return out
