"""Template checks, typed import and validation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.schemas import METRIC_NUMBERS, METRIC_TEXT

Rules = list[tuple[str, str]]


def header_difference(header: Column, template: T.StructType) -> Column:
    """(side, column) pairs in which a header differs from the template, case-sensitive."""
    expected = F.array(*[F.lit(n) for n in template.names])

    def tagged(side: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(side).alias("side"), n.alias("column")))

    return F.concat(
        tagged("missing", F.array_except(expected, header)),
        tagged("extra", F.array_except(header, expected)),
    )


def schema_diff(sheets: DataFrame, key: str, header: str, template: T.StructType) -> DataFrame:
    """Header problems of many sheets, row by row and without a shuffle."""
    diff = F.inline(header_difference(F.col(header), template))
    return sheets.select(key, diff)


def check_header(columns: list[str], template: T.StructType) -> None:
    missing = [c for c in template.names if c not in columns]
    extra = [c for c in columns if c not in template.names]
    if missing:
        raise ValueError(f"columns missing from the input: {', '.join(missing)}")
    if extra:
        raise ValueError(f"columns not defined in the template: {', '.join(extra)}")


def _bad(field: T.StructField) -> Column:
    """Does the cell hold text its type cannot take; null cells are fine."""
    cell = F.col(field.name)
    return cell.isNotNull() & cell.try_cast(field.dataType).isNull()


def typed_rows(df: DataFrame, template: T.StructType, strict: bool = True) -> DataFrame:
    """Text columns as the template's types, bound by name.

    ``strict`` fails on the first bad cell; otherwise rows with bad cells are left out,
    see :func:`typed_rejects`.
    """
    if strict:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in template])
    good = df
    for field in template:
        good = good.where(~_bad(field))
    return good.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in template])


def typed_rejects(df: DataFrame, template: T.StructType) -> DataFrame:
    """Rows with bad cells and the names of those cells."""
    names = F.concat_ws(",", *[F.when(_bad(f), f.name) for f in template])
    return df.withColumn("bad_columns", names).where(F.col("bad_columns") != "")


#: Columns of a one-pass import beside the mapped ones.
RAW, BAD, ACCEPTED = "_raw", "_bad_columns", "_accepted"


def sorted_out(df: DataFrame, template: T.StructType, mapping: dict[str, str] | None = None) -> DataFrame:
    """All rows in one pass: typed cells under their mapped names, and for rows with bad cells their text and the bad names."""
    names = mapping or {f.name: f.name for f in template}
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(names[f.name]) for f in template if f.name in names]
    marked = df.withColumn(BAD, F.nullif(F.concat_ws(",", *[F.when(_bad(f), f.name) for f in template]), F.lit("")))
    raw = F.when(F.col(BAD).isNotNull(), F.struct(*[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in template]))
    return marked.select(*typed, raw.alias(RAW), BAD, F.col(BAD).isNull().alias(ACCEPTED))


def sorted_out_schema(template: T.StructType, mapping: dict[str, str] | None = None) -> T.StructType:
    """Schema of :func:`sorted_out`."""
    names = mapping or {f.name: f.name for f in template}
    return T.StructType([
        *[T.StructField(names[f.name], f.dataType) for f in template if f.name in names],
        T.StructField(RAW, T.StructType([T.StructField(f.name, T.StringType()) for f in template])),
        T.StructField(BAD, T.StringType()), T.StructField(ACCEPTED, T.BooleanType()),
    ])


def breaks_rules(rules: Rules) -> Column:
    """Whether a row breaks any rule; a rule that is null counts as broken."""
    valid = F.lit(True)
    for _, rule in rules:
        valid = valid & _holds(rule)
    return ~valid


def required_rules(numbers: tuple[str, ...] = METRIC_NUMBERS, text: str = METRIC_TEXT) -> Rules:
    """Every field must be given."""
    rules = [(f"{n}_required", f"`{n}` IS NOT NULL") for n in numbers]
    return rules + [(f"{text}_required", rf"`{text}` RLIKE '(?U)\\S'")]


def _holds(rule: str) -> Column:
    return F.coalesce(F.expr(rule), F.lit(False))


def validation_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """Total rows and rows that break any rule, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(breaks_rules(rules)).alias("rejected_rows")
    )


def validation_by_rule(df: DataFrame, rules: Rules) -> DataFrame:
    counted = df.agg(*[F.count_if(~_holds(rule)).alias(name) for name, rule in rules])
    pairs = ", ".join(f"'{name}', `{name}`" for name, _ in rules)
    return counted.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, rejected_rows)")


def property_names(template: T.StructType) -> dict[str, str]:
    """Mapping for :func:`map_columns` that drops the spaces of column names."""
    return {name: name.replace(" ", "") for name in template.names}


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Source -> destination names; without a mapping every column keeps its name."""
    if mapping is None:
        return df
    return df.select(*[F.col(source).alias(target) for source, target in mapping.items()])
