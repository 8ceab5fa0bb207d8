import datetime as dt

from conftest import as_rows

from granary.operators.deals import provider_deals, resolve_measures

SCHEMA = "trade_id string, category string, indicator_type string, indicator_sub_type string, measure_value string, seq int"


def b_rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def v1(spark, *rows):
    full = [(t, "x", "y", i, m, n) for n, (t, i, m) in enumerate(rows)]
    return dict(as_rows(resolve_measures(b_rows(spark, *full), "seq")))


def test_last_preferred_value_wins(spark):
    assert v1(spark, ("a", "settleDatePosition", "1"), ("A ", "SETTLEDATEPOSITION", "2"),
              ("a", "OriginalTradeAmount", "9")) == {"A": "2"}


def test_blank_values_do_not_overwrite(spark):
    assert v1(spark, ("a", "settleDatePosition", "1"), ("a", "settleDatePosition", " \t"),
              ("a", "settleDatePosition", None)) == {"A": "1"}


def test_fallback_when_nothing_is_preferred(spark):
    assert v1(spark, ("a", "settleDatePosition", ""), ("a", "OriginalTradeAmount", "5"),
              ("a", "originaltradeamount", " 6 ")) == {"A": "6"}


def test_key_without_value_stays_with_null(spark):
    assert v1(spark, ("a", None, "5"), ("b", "other", "5"), ("  ", "settleDatePosition", "5"),
              (None, "settleDatePosition", "5")) == {"A": None, "B": None}


def test_filter_drops_rows_and_their_keys(spark):
    rows = b_rows(
        spark,
        ("a", "INVENTORYPOSITION", " nominal", "settleDatePosition", "1", 1),
        ("a", "other", "nominal", "settleDatePosition", "2", 2),
        ("b", "inventoryposition", "percent", "settleDatePosition", "3", 3),
        ("c", None, "nominal", "settleDatePosition", "4", 4),
    )
    assert dict(as_rows(resolve_measures(rows, "seq", filtered=True))) == {"A": "1"}


def deals(spark, hot_rows):
    day = dt.date(2020, 1, 2)
    keys = ["hot"] * 500 + ["cold", "none", " ", None]
    a = spark.createDataFrame(
        [(f" d{i} ", k, "b", "t", "p", day, day, day, None) for i, k in enumerate(keys)],
        "deal_id string, trade_id string, book_code string, tsip string, provider_id string, "
        "trade_date date, business_date date, settlement_date date, buy_price decimal(18,2)",
    ).repartition(7)
    measures = spark.createDataFrame(
        [("HOT", "1"), ("COLD", "2"), ("UNUSED", "3")], "trade_key string, measure_value string"
    )
    return provider_deals(a, measures, day, hot_rows)


def test_lookup_is_the_same_with_and_without_hot_keys(spark):
    plain = as_rows(deals(spark, 1_000_000), "deal_id")
    salted = as_rows(deals(spark, 10), "deal_id")
    assert plain == salted and len(plain) == 502
    found = {r[1]: r[9] for r in plain}
    assert found == {"hot": "1", "cold": "2", "none": None}
    assert all(r[0] == r[0].strip() and r[10] == dt.date(2020, 1, 2) for r in plain)
