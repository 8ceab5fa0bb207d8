"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import schemas

RUN_DATE = dt.date(2000, 6, 30)
RUN_TS = dt.datetime(2000, 6, 30)
AS_OF = dt.date(1998, 10, 3)
RUN_ID = 77
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
LINE_KEYS = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_orderkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names or TABLES}


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all four routed types, an unknown type, and blank lines."""
    def lines(name: str, expr: str) -> DataFrame:
        return table(spark, sf_dir, name).selectExpr(f"{expr} AS value")

    parts = [
        lines("part", "concat_ws('|', '06', p_partkey, p_name, p_brand, p_size)"),
        lines("supplier", "concat_ws('|', '07', s_suppkey, s_name, s_nationkey)"),
        lines("nation", "concat_ws('|', '09', n_nationkey)"),
        lines("customer",
              "concat_ws('|', '12', c_custkey, c_name, c_nationkey, c_mktsegment, '', 'x7', 'x8')"),
        lines("region", "concat_ws('|', '99', r_name)"),
        lines("region", "'  '"),
    ]
    return reduce(DataFrame.unionAll, parts)


def file_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_linenumber % 2 = 0 THEN concat(' t', l_orderkey, ' ') "
        "ELSE concat('T', l_orderkey, ' ') END AS trade_id",
        "CASE WHEN l_linestatus = 'F' THEN 'inventoryposition' ELSE 'Other' END AS category",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'Percent' ELSE 'Nominal' END AS indicator_type",
        "CASE l_returnflag WHEN 'A' THEN 'settleDatePosition' "
        "WHEN 'R' THEN 'ORIGINALTRADEAMOUNT' END AS indicator_sub_type",
        "CASE WHEN l_quantity < 10 THEN '  ' ELSE CAST(l_partkey AS STRING) END AS measure_value",
        "struct(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq",
    )


def file_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('D', o_orderkey) AS deal_id",
        "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('t', o_orderkey) END AS trade_id",
        "o_orderpriority AS book_code",
        "concat(' S', o_custkey) AS tsip",
        "concat('P', o_custkey % 10) AS provider_id",
        "to_date(o_orderdate) AS trade_date",
        "to_date(o_orderdate) AS business_date",
        "date_add(to_date(o_orderdate), 2) AS settlement_date",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS buy_price",
    )


def archival_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "CASE o_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END AS table_configuration_id",
        "CASE WHEN o_orderkey % 7 <> 0 THEN to_date(o_orderdate) END AS as_of_date",
        "CASE WHEN o_custkey % 3 = 1 THEN 'EXT' WHEN o_orderkey % 11 = 0 THEN 'EOY' "
        "WHEN o_orderkey % 5 = 0 THEN 'EOQ' WHEN o_orderkey % 3 = 0 THEN 'EOM' ELSE 'EOD' END AS date_type",
        "'devstore' AS storage_account_name",
        "'archival' AS container_name",
        "concat('/a/b/', o_orderkey) AS blob_path",
        "concat('e', o_orderkey) AS etag",
        "'application/octet-stream' AS content_type",
        "CAST(o_totalprice AS BIGINT) AS file_size_bytes",
        "CAST(o_custkey AS BIGINT) AS row_count",
        "CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'Created' ELSE 'Deleted' END AS status",
        "o_orderdate AS created_at_et",
        "CAST(NULL AS STRING) AS archival_policy_tag",
        "CASE o_custkey % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'COOL' WHEN 2 THEN 'archive' "
        "ELSE 'Cold' END AS current_access_tier",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL 10 DAYS END "
        "AS last_tier_check_at_et",
        "CASE WHEN o_orderkey % 13 = 0 THEN 4 END AS override_file_lifecycle_policy_id",
        "CAST(NULL AS TIMESTAMP_NTZ) AS last_tags_sync_at_et",
    )


def exemptions(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 10, dt.date(1997, 3, 14), "Table", "audit hold"),
        (2, 30, None, "Table", "legal hold"),
        (3, 10, AS_OF, "File", "tag only"),
    ]
    return schemas.local_table(spark, rows, schemas.EXEMPTION)


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their text, each with one of 300 days."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", "lang", "n_chars", "date_add(DATE'1996-01-01', CAST(pmod(doc_id, 300) AS INT)) AS as_of_date")


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cells of text; some of them do not convert."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS DocId", "CASE WHEN doc_id % 7 = 3 THEN 'n/a' ELSE CAST(n_chars AS STRING) END AS Chars",
        "source AS Source")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document, of three configurations and 300 days, some without a day."""
    return dated_documents(spark, sf_dir).selectExpr(
        "CAST(10 * (1 + doc_id % 3) AS INT) AS table_configuration_id", "CASE WHEN doc_id % 11 <> 0 THEN as_of_date END AS as_of_date",
        "concat('/d/', doc_id) AS blob_path", "CAST(n_chars AS BIGINT) AS file_size_bytes", "'Active' AS status",
        "TIMESTAMP_NTZ'2000-01-01 00:00:00' AS created_at_et", "doc_id")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    slash = "date_format(o_orderdate, 'yyyy/MM/dd')"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        f"CASE o_orderkey % 4 WHEN 0 THEN concat('external/db/t/', {slash}, '/f.parquet') "
        "WHEN 1 THEN concat('external/t/', date_format(o_orderdate, 'yyyy-MM-dd'), '/x.csv') "
        "WHEN 2 THEN concat('a', chr(92), '2024', chr(92), '13', chr(92), '45', chr(92), "
        "'2024-02-30', chr(92), date_format(o_orderdate, 'yyyy'), chr(92), "
        "date_format(o_orderdate, 'MM'), chr(92), date_format(o_orderdate, 'dd')) "
        "ELSE 'external/none/20240101.csv' END AS path",
    )


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN '2024-1-5' "
        "WHEN 2 THEN '2024-02-30' WHEN 3 THEN '' END AS text",
    )


def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells for template 1, some of which do not convert."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(CASE WHEN l_quantity = 1 THEN 'x' ELSE '' END, l_suppkey) AS FundId",
        "CAST(month(l_shipdate) AS STRING) AS Month",
        "CAST(year(l_shipdate) AS STRING) AS Year",
        "CASE WHEN l_quantity = 2 THEN '' ELSE CAST(CAST(l_discount AS DECIMAL(4,2)) AS STRING) END AS Return",
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header line per order; a third have a wrong name and a surplus column."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS sheet_id",
        "split(CASE o_orderkey % 3 WHEN 0 THEN 'FundId|Month|Returns|Extra' "
        "WHEN 1 THEN 'Return|Year|Month|FundId' ELSE 'FundId|Month|Year|return' END, '[|]') AS header",
    )


CUSTOMER_RULES = [
    ("balance_not_negative", "c_acctbal >= 0"),
    ("known_segment", "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')"),
    ("name_given", r"c_name RLIKE '\\S'"),
]
