import datetime as dt

import pytest
from conftest import as_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import dates, json, text
from granary.operators import documents


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("local, utc", [
    ("2024-03-10 02:30", "2024-03-10 07:30"), ("2024-11-03 01:30", "2024-11-03 06:30"),
    ("2024-11-03 02:30", "2024-11-03 07:30"), ("2024-11-03 00:59", "2024-11-03 04:59"),
    ("2024-07-01 00:00", "2024-07-01 04:00"), ("2024-01-01 00:00", "2024-01-01 05:00"),
])
def test_local_to_utc(spark, local, utc):
    parse = dt.datetime.fromisoformat
    assert one(spark, parse(local), lambda c: dates.local_to_utc(c, "America/New_York"), "timestamp_ntz") == parse(utc)
    seconds = one(spark, parse(local), lambda c: F.unix_seconds(dates.local_to_instant(c, "America/New_York")), "timestamp_ntz")
    assert seconds == parse(utc).replace(tzinfo=dt.timezone.utc).timestamp()


@pytest.mark.parametrize("value, day", [
    ("2024-01-05", dt.date(2024, 1, 5)), ("2024-1-5", None), ("2024-02-30", None), ("2024-01-05x", None), ("", None), (None, None),
])
def test_strict_date(spark, value, day):
    assert one(spark, value, dates.parse_iso_date) == day


def test_stamp(spark):
    assert one(spark, dt.datetime(2025, 2, 25, 13, 4, 5), dates.stamp, "timestamp_ntz") == "20250225_130405"


@pytest.mark.parametrize("value, out", [("\t a b \n", "a b"), ("", ""), ("　", ""), (None, None)])
def test_trim(spark, value, out):
    assert one(spark, value, text.clean_trim) == out
    assert one(spark, value, text.non_blank) is bool(out)


def test_rename_word(spark):
    rename = lambda name: (lambda c: text.rename_word(c, r"class\s+(\w+)", F.lit(name)))
    source = "class Foo { foo x; Foobar y; } // FOO"
    assert one(spark, source, rename("Ba$r")) == "class Ba$r { Ba$r x; Foobar y; } // Ba$r"
    assert one(spark, "no match", rename("Bar")) == "no match"
    assert one(spark, "class Bar bar", rename("Bar")) == "class Bar bar"


def test_line_filters(spark):
    source = "keep a\r\n  keep b\ndrop\n\nkeep c"
    assert one(spark, source, lambda c: text.keep_lines(c, "keep")) == "keep a\n  keep b\nkeep c"
    assert one(spark, "x", lambda c: text.keep_lines(c, "keep")) == ""
    squeeze = lambda c: text.drop_blank_line_after(c, r"\[Table[^\]]*\]")
    assert one(spark, "[Table(1)]\n\nclass\n\nend", squeeze) == "[Table(1)]\nclass\n\nend"


@pytest.mark.parametrize("name, out", [("TableName", "tableName"), ("SKUSize", "skuSize"), ("ID", "id"), ("already", "already"), ("A", "a")])
def test_camel_case(name, out):
    assert text.camel_case(name) == out


def test_json_rename_keeps_mapped_keys_only(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert one(spark, '{"a": 1, "b": "x", "c": 2}', lambda c: json.rename_json(c, schema, {"a": "first", "b": "second"})) == '{"first":1,"second":"x"}'


def test_xml(spark):
    schema = T.StructType([T.StructField("n", T.StringType()), T.StructField("o", T.StructType([T.StructField("p", T.StringType())]))])
    xml = '<?xml version="1.0"?><cfg><n>1</n><o><p>a&amp;b</p></o></cfg>'
    assert one(spark, xml, lambda c: json.xml_as_json(c, "cfg", schema)) == '{"cfg":{"n":"1","o":{"p":"a&b"}}}'


def test_json_shape(spark):
    df = spark.createDataFrame([('{"s":"x","i":1,"d":1.5,"b":true,"o":{"k":2,"p":{"q":1}},"a":[1],"n":null}',), ('{"i":"t"}',), ("bad{",)], "j string")
    every = {(r.path, r.kind): r.n for r in documents.json_shape(df, "j").collect()}
    flat = {k: n for k, n in every.items() if "." not in k[0]}
    assert flat == {("s", "string"): 1, ("i", "int"): 1, ("i", "string"): 1, ("d", "double"): 1, ("b", "bool"): 1,
                    ("o", "object"): 1, ("a", "object"): 1, ("n", "object"): 1}
    assert every.keys() - flat.keys() == {("o.k", "int"), ("o.p", "object"), ("o.p.q", "int")}
    assert documents.json_shape(df.where("false"), "j").count() == 0
    assert documents.json_schema(df, "j").first()[0].startswith("OBJECT<")


def test_nested_json_keeps_source_order(spark):
    df = spark.createDataFrame([("t", 3, "c"), ("t", 1, "a"), ("u", 5, "z"), ("t", 2, "b")], "name string, seq int, col string")
    out = documents.nested_json(df, ["name"], "seq", F.struct("col"), "columns", rows_per_chunk=2)
    assert as_rows(out.select("name", "chunk", "json"), "name", "chunk") == [
        ("t", 0, '{"name":"t","columns":[{"col":"a"},{"col":"b"}]}'), ("t", 1, '{"name":"t","columns":[{"col":"c"}]}'),
        ("u", 0, '{"name":"u","columns":[{"col":"z"}]}'),
    ]


def test_ordered_text_has_no_trailing_separator(spark):
    df = spark.createDataFrame([("e", 2, "Two"), ("e", 1, "One")], "g string, id int, d string")
    line = F.format_string("[%d] %s = %d", "id", "d", "id")
    assert as_rows(documents.ordered_text(df, ["g"], "id", line, ",\n", rows_per_chunk=1000)) == [("e", 0, "[1] One = 1,\n[2] Two = 2")]


def test_matching_lines(spark):
    df = spark.createDataFrame([(1, "  Abc\r\nxyz\rQ\n")], "id int, text string")
    assert as_rows(documents.matching_lines(df, "id", r"^\s*[A-Z]"), "line_no") == [(1, 0, "  Abc"), (1, 2, "Q")]


def test_search(spark):
    df = spark.createDataFrame([(1, "MIT Licence"), (2, "none"), (3, "a license")], "id int, text string")
    assert as_rows(documents.text_search(df, "licen[cs]e").select("id"), "id") == [(1,), (3,)]
    assert as_rows(documents.text_search_summary(df.withColumn("l", F.lit("en")), "LICEN[CS]E", ["l"])) == [("en", 3, 2)]


def test_overlaps_of_any_size_take_the_later_instant(spark):
    from granary.functions.dates import local_to_utc

    def utc(text, zone):
        return spark.sql(f"select timestamp_ntz'{text}' t").select(local_to_utc(F.col("t"), zone)).first()[0].strftime("%d %H:%M")

    assert utc("2024-04-07 01:45:00", "Australia/Lord_Howe") == "06 15:15"
    assert utc("2024-04-07 03:00:00", "Australia/Lord_Howe") == "06 16:30"
    assert utc("2024-11-03 01:30:00", "America/New_York") == "03 06:30"
    assert utc("2024-07-01 12:00:00", "America/New_York") == "01 16:00"
    assert utc("2024-03-10 02:30:00", "America/New_York") == "10 07:30"


def test_names_may_hold_quotes(spark):
    from granary.operators import catalog

    df = spark.createDataFrame([("a",), (None,)], T.StructType([T.StructField("it's", T.StringType())]))
    got = catalog.columns_by_type({"o'neil": df}, ("string",)).collect()
    assert [(r.table_name, r.column_name, r.n_rows, r.n_nulls) for r in got] == [("o'neil", "it's", 2, 1)]
    rows = spark.createDataFrame([("g", 1, "x"), ("g", 2, "y")], "g string, seq int, t string")
    assert documents.ordered_text(rows, ["g"], "seq", F.col("t"), "'", rows_per_chunk=5).first()["body"] == "x'y"
