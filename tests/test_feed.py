from conftest import as_rows
from pyspark.sql import functions as F

from granary.operators import feed

SAMPLE = ["06|1|a|b|c|extra", "07|x", "", " \t ", "12|1||3|4|", "99|z", "06", "06x|1", " 06|1"]


def test_blank_lines_are_read_but_not_records(lines):
    row = feed.feed_totals(lines(*SAMPLE)).first().asDict()
    assert row["lines_read"] == 9 and row["blank_lines"] == 2
    assert row["unrouted_lines"] == 3
    taken = sum(v for k, v in row.items() if k not in ("lines_read",))
    assert taken == row["lines_read"]


def test_routes_pad_and_cut(lines):
    df = lines(*SAMPLE)
    assert as_rows(feed.route(df, "06"), "col2") == [
        ("06", "", "", "", ""), ("06", "1", "a", "b", "c"),
    ]
    assert as_rows(feed.route(df, "07")) == [("07", "x", "", "")]
    assert as_rows(feed.route(df, "12")) == [("12", "1", "", "3", "4", "")]
    assert as_rows(feed.route(df, "12", empty_as_null=True)) == [("12", "1", None, "3", "4", None)]


def test_quotes_do_not_protect_the_delimiter(lines):
    assert as_rows(feed.route(lines('09|"a|b"'), "09")) == [("09", '"a', 'b"')]


def test_type_is_compared_exactly(lines):
    assert as_rows(feed.unrouted(lines(*SAMPLE)), "value") == [
        (" 06", " 06|1"), ("06x", "06x|1"), ("99", "99|z"),
    ]


def test_every_line_lands_in_one_table(lines):
    routed = feed.routed_rows(lines(*SAMPLE))
    counts = dict(as_rows(routed.groupBy("table_name").count()))
    assert counts == {"product": 2, "inventory": 1, "deals": 1, "_unrouted": 3, "_blank": 2}
    wide = routed.where("table_name = 'inventory'").select("col4", "col5", "value").first()
    assert tuple(wide) == ("", None, None)
    assert routed.where(F.col("value").isNotNull()).count() == 5


def test_counts_by_type(lines):
    assert dict(as_rows(feed.record_type_counts(lines(*SAMPLE)))) == {
        "06": 2, "07": 1, "12": 1, "99": 1, "06x": 1, " 06": 1,
    }
