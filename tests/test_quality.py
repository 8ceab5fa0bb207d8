import pytest
from conftest import as_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schemas
from granary.operators import catalog, quality

T1 = schemas.TEMPLATES["Template1"]


def test_header_difference(spark):
    df = spark.createDataFrame(
        [(1, ["FundId", "Month", "Returns", "Extra"]), (2, ["Return", "Year", "Month", "FundId"]), (3, ["fundid", "Month", "Year", "Return"])],
        "k int, h array<string>",
    )
    assert as_rows(quality.schema_diff(df, "k", "h", T1), "k", "side", "column") == [
        (1, "extra", "Extra"), (1, "extra", "Returns"), (1, "missing", "Return"), (1, "missing", "Year"),
        (3, "extra", "fundid"), (3, "missing", "FundId"),
    ]


def test_check_header():
    quality.check_header(["Return", "Year", "Month", "FundId"], T1)
    with pytest.raises(ValueError, match="missing.*Year, Return"):
        quality.check_header(["FundId", "Month", "Returns"], T1)
    with pytest.raises(ValueError, match="Extra"):
        quality.check_header([*T1.names, "Extra"], T1)


CELLS = [("1", "2", "3", "0.5"), ("x", "2", "3", ""), ("4", None, "3", "1e3"), ("5", "2", "9999999999", "1")]


def cells(spark):
    return spark.createDataFrame(CELLS, "FundId string, Month string, Year string, `Return` string")


def test_typed_and_rejected_rows(spark):
    good = as_rows(quality.typed_rows(cells(spark), T1, strict=False), "FundId")
    assert good == [(1, 2, 3, 0.5), (4, None, 3, 1000.0)]
    bad = quality.typed_rejects(cells(spark), T1)
    assert as_rows(bad.select("FundId", "bad_columns"), "FundId") == [("5", "Year"), ("x", "FundId,Return")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        quality.typed_rows(cells(spark), T1).collect()


def test_validation_counts_nulls_as_failures(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,), (5,)], "v int")
    rules = [("positive", "v > 0"), ("small", "v < 3")]
    assert as_rows(quality.validation_counts(df, rules)) == [(4, 3)]
    assert dict(as_rows(quality.validation_by_rule(df, rules))) == {"positive": 2, "small": 2}


def test_required_fields(spark):
    full = {n: 1.0 for n in schemas.METRIC_NUMBERS} | {schemas.METRIC_TEXT: "ok"}
    df = spark.createDataFrame(
        [full, full | {schemas.METRIC_TEXT: " "}, full | {schemas.METRIC_NUMBERS[5]: None}], schemas.METRIC_FORM
    )
    assert as_rows(quality.validation_counts(df, quality.required_rules())) == [(3, 2)]


def test_unknown_template():
    with pytest.raises(ValueError, match="'Nope' is not defined"):
        schemas.template("Nope")


def test_property_names_drop_spaces(spark):
    spaced = T.StructType([T.StructField("Fund Id", T.IntegerType()), T.StructField("Month", T.IntegerType())])
    df = spark.createDataFrame([("1", "2")], "`Fund Id` string, Month string")
    assert quality.map_columns(quality.typed_rows(df, spaced), quality.property_names(spaced)).columns == ["FundId", "Month"]


def test_mapping(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert quality.map_columns(df, {"b": "x"}).columns == ["x"]
    assert quality.map_columns(df).columns == ["a", "b"]


def test_binary_columns(spark):
    schema = "b int, n int, z int, f boolean, t tinyint, big bigint"
    tables = {
        "some": spark.createDataFrame([(0, 2, None, True, 1, 1), (1, 0, None, None, 0, 0), (None, 1, None, False, 1, 1)], schema),
        "empty": spark.createDataFrame([], "e int"),
        "text": spark.createDataFrame([("1",)], "s string"),
    }
    assert as_rows(catalog.binary_columns(tables), "table_name", "column_name") == [
        ("empty", "e"), ("some", "b"), ("some", "f"), ("some", "t"), ("some", "z"),
    ]


def test_columns_by_type_and_table_list(spark):
    tables = {"a": spark.createDataFrame([(1, None)], "x int, y bigint"), "b": spark.createDataFrame([(1,)], "x int")}
    assert catalog.table_list("a,,c") == ["a", "", "c"]
    assert as_rows(catalog.columns_by_type(tables, ("int", "bigint"), ["a", "", "c"]), "ordinal") == [
        ("a", "x", "int", 1, 1, 0), ("a", "y", "bigint", 2, 1, 1),
    ]


def test_type_map(spark):
    df = spark.createDataFrame(
        [(1, "a" * 1000, None, None)], T.StructType([
            T.StructField("Id", T.LongType()), T.StructField("long text", T.StringType()),
            T.StructField("when", T.DateType()), T.StructField("m", T.MapType(T.StringType(), T.StringType())),
        ])
    )
    got = {r.column_name: r for r in catalog.catalog_type_map({"role": df}).collect()}
    assert got["Id"].class_name == "Role" and got["Id"].target_type == "long" and not got["Id"].required
    assert got["long_text"].required and got["long_text"].max_length == 1000 and not got["long_text"].declared
    assert (got["when"].target_type, got["when"].null_mark, got["when"].required) == ("DateTime", "?", False)
    assert got["m"].target_type == "UNKNOWN_map<string,string>" and got["m"].null_mark == ""


def test_convert_timestamps_touches_listed_tables_only(spark):
    df = spark.sql("select 1 a, timestamp_ntz'2024-07-01 08:00:00' t")
    out = catalog.convert_timestamps({"x": df, "y": df}, "x,z", "America/New_York")
    assert out["x"].schema["t"].dataType == T.TimestampType() and out["y"].schema["t"].dataType == T.TimestampNTZType()
    assert out["x"].select(F.unix_seconds("t")).first()[0] == 1719835200
