"""Registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schemas
from granary.functions import dates, json, paths, text, tiers
from granary.operators import (
    archive, catalog, deals, documents, feed, lifecycle, quality, retention,
)
from granary.registry import fixtures as fx
from granary.sources.tables import scan_as_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------------------- feeds


@query
def record_type_counts(spark, sf):
    return feed.record_type_counts(fx.feed(spark, sf))


@query
def feed_totals(spark, sf):
    return feed.feed_totals(fx.feed(spark, sf))


@query
def route_product(spark, sf):
    return feed.route(fx.feed(spark, sf), "06")


@query
def route_inventory(spark, sf):
    return feed.route(fx.feed(spark, sf), "07")


@query
def route_trade(spark, sf):
    return feed.route(fx.feed(spark, sf), "09")


@query
def route_deals(spark, sf):
    return feed.route(fx.feed(spark, sf), "12")


@query
def unrouted_records(spark, sf):
    return feed.unrouted(fx.feed(spark, sf))


# --------------------------------------------------------------------------- deals


@query
def measure_resolve_v1(spark, sf):
    return deals.resolve_measures(fx.file_b(spark, sf), "seq")


@query
def measure_resolve_v2(spark, sf):
    return deals.resolve_measures(fx.file_b(spark, sf), "seq", filtered=True)


@query
def provider_deals(spark, sf):
    measures = deals.resolve_measures(fx.file_b(spark, sf), "seq", filtered=True)
    return deals.provider_deals(fx.file_a(spark, sf), measures, fx.RUN_DATE)


# ----------------------------------------------------------------------- retention


def _typed(spark, sf) -> DataFrame:
    """Dates of two archived tables: orders under configuration 10, line items under 30."""
    days = [
        retention.as_of_dates(fx.table(spark, sf, name), column).withColumn(retention.CONFIG, F.lit(config))
        for name, column, config in (("orders", "o_orderdate", 10), ("lineitem", "l_shipdate", 30))
    ]
    return retention.date_types(days[0].unionByName(days[1]))


def _policies(spark) -> tuple[DataFrame, DataFrame]:
    return schemas.table_configurations(spark), schemas.retention_policies(spark)


def _candidates(spark, sf) -> DataFrame:
    return retention.candidate_dates(_typed(spark, sf), *_policies(spark))


@query
def scan_orders_as_of(spark, sf):
    return scan_as_of(fx.table(spark, sf, "orders"), "o_orderdate", fx.AS_OF)


@query
def distinct_as_of(spark, sf):
    return retention.as_of_dates(fx.table(spark, sf, "orders"), "o_orderdate")


@query
def date_types(spark, sf):
    return _typed(spark, sf)


@query
def retention_keep(spark, sf):
    return retention.keep_dates(_typed(spark, sf), *_policies(spark))


@query
def retention_candidates(spark, sf):
    return _candidates(spark, sf).orderBy("as_of_date")


@query
def archive_plan(spark, sf):
    configs, _ = _policies(spark)
    return retention.archive_plan(
        _candidates(spark, sf), configs, fx.archival_files(spark, sf), fx.exemptions(spark)
    )


@query
def archive_decisions(spark, sf):
    configs, _ = _policies(spark)
    return retention.archive_decisions(
        _candidates(spark, sf), configs, fx.archival_files(spark, sf), fx.exemptions(spark)
    )


# ------------------------------------------------------------------------- archive


def _ship_parts(spark, sf) -> DataFrame:
    lines = fx.table(spark, sf, "lineitem").withColumn("as_of_date", F.to_date("l_shipdate"))
    return archive.assign_parts(lines, archive.content_slice(fx.LINE_KEYS[1:]), rows_per_part=10)


@query
def export_parts(spark, sf):
    return (
        _ship_parts(spark, sf).groupBy("as_of_date", "part_index")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("l_orderkey").alias("min_orderkey"),
            F.max("l_orderkey").alias("max_orderkey"),
            F.sum("l_partkey").alias("partkey_sum"),
        )
        .orderBy("as_of_date", "part_index")
    )


def _part_plan(spark, sf, rows_per_part: int = 10) -> DataFrame:
    rows = (
        fx.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("as_of_date"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    sizes = archive.part_sizes(rows, rows_per_part)
    return sizes.withColumn("file_size_bytes", F.col("row_count") * 100)


@query
def export_totals(spark, sf):
    return archive.export_totals(_part_plan(spark, sf))


def _manifest(spark, sf) -> DataFrame:
    parts = (
        _part_plan(spark, sf).withColumn(retention.CONFIG, F.lit(10)).withColumn("date_type", F.lit("EOD"))
    )
    return archive.manifest(
        parts, schemas.table_configurations(spark), schemas.lifecycle_policies(spark),
        fx.exemptions(spark), fx.RUN_TS,
    )


@query
def part_paths(spark, sf):
    return _manifest(spark, sf).drop("tags")


@query
def file_tags(spark, sf):
    return _manifest(spark, sf).select("blob_path", F.explode("tags").alias("tag", "tag_value"))


@query
def run_detail_plan(spark, sf):
    decisions = archive_decisions(spark, sf)
    orders = fx.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("as_of_date"))
    exported = orders.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(10).alias(retention.CONFIG), "as_of_date", "row_count",
        F.ceil(F.col("row_count") / 8).alias("part_count"),
        F.concat(F.lit("/p/"), F.col("as_of_date").cast("string")).alias("file_path"),
    )
    deleted = exported.select(
        retention.CONFIG, "as_of_date", F.col("row_count").alias("expected_rows"),
        F.when(F.dayofmonth("as_of_date") == 1, F.col("row_count") - 1)
        .otherwise(F.col("row_count")).alias("actual_rows"),
    )
    return archive.run_details(decisions, exported, archive.delete_reconcile(deleted), fx.RUN_ID)


@query
def upsert_files(spark, sf):
    files = fx.archival_files(spark, sf).select(
        retention.CONFIG, "as_of_date", "blob_path", "status", "file_size_bytes",
        F.col("created_at_et").alias("updated_at"),
    )
    created = files.where("status <> 'Deleted'").withColumn("status", F.lit("Created"))
    active = files.where("status = 'Active'").withColumns({
        "updated_at": F.expr("updated_at + INTERVAL 1 HOUR"),
        "file_size_bytes": F.col("file_size_bytes") + 1,
    })
    return archive.upsert_files(files.unionByName(created), active, "updated_at")


@query
def delete_survivors(spark, sf):
    return archive.survivors(fx.table(spark, sf, "orders"), "o_orderdate", fx.AS_OF)


@query
def delete_reconcile(spark, sf):
    day = F.to_date("o_orderdate").alias("as_of_date")
    actual = fx.table(spark, sf, "orders").groupBy(day).agg(F.count(F.lit(1)).alias("actual_rows"))
    surplus = F.when(F.col("as_of_date") == F.lit(fx.AS_OF), 1).otherwise(0)
    return archive.delete_reconcile(
        actual.withColumn("expected_rows", F.col("actual_rows") + surplus)
    )


# ----------------------------------------------------------------------- lifecycle


@query
def policy_unpivot(spark, sf):
    """Thresholds with the number of files each one governs."""
    rules = lifecycle.policy_thresholds(schemas.lifecycle_policies(spark))
    governed = lifecycle.with_desired_tier(
        fx.archival_files(spark, sf), schemas.table_configurations(spark),
        schemas.lifecycle_policies(spark), fx.RUN_DATE,
    ).groupBy("policy_id", "date_type").agg(F.count(F.lit(1)).alias("files"))
    return rules.join(governed, ["policy_id", "date_type"], "left")


@query
def policy_cutoff(spark, sf):
    """Cutoff per configuration, with the number of its files at or beyond it."""
    cutoffs = lifecycle.policy_cutoffs(
        schemas.table_configurations(spark), schemas.lifecycle_policies(spark), fx.RUN_DATE
    )
    age_date = F.coalesce("as_of_date", F.to_date("created_at_et")).alias("age_date")
    per_day = (
        fx.archival_files(spark, sf).groupBy(retention.CONFIG, age_date)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        cutoffs.join(per_day, retention.CONFIG, "left")
        .groupBy(retention.CONFIG, "min_days", "cutoff_date")
        .agg(
            F.coalesce(F.sum(F.when(F.col("age_date") <= F.col("cutoff_date"), F.col("n"))), F.lit(0))
            .alias("files_due")
        )
    )


@query
def lifecycle_candidates(spark, sf):
    cutoffs = lifecycle.policy_cutoffs(
        schemas.table_configurations(spark), schemas.lifecycle_policies(spark), fx.RUN_DATE
    )
    page = lifecycle.lifecycle_candidates(fx.archival_files(spark, sf), cutoffs, fx.RUN_TS, page_size=500)
    return page.select(
        retention.CONFIG, "id", "as_of_date", "last_tier_check_at_et", "cutoff_date", "page_rank"
    )


@query
def desired_tier(spark, sf):
    return lifecycle.with_desired_tier(
        fx.archival_files(spark, sf), schemas.table_configurations(spark),
        schemas.lifecycle_policies(spark), fx.RUN_DATE,
    ).select("id", retention.CONFIG, "date_type", "policy_id", "age_days", "desired_tier")


@query
def lifecycle_actions(spark, sf):
    return lifecycle.lifecycle_actions(
        fx.archival_files(spark, sf), schemas.table_configurations(spark),
        schemas.lifecycle_policies(spark), fx.RUN_TS, "DEVSTORE",
    )


@query
def lifecycle_summary(spark, sf):
    return lifecycle.lifecycle_summary(lifecycle_actions(spark, sf))


@query
def file_full_view(spark, sf):
    return lifecycle.file_full_view(
        fx.archival_files(spark, sf), schemas.table_configurations(spark),
        schemas.lifecycle_policies(spark), schemas.retention_policies(spark),
    )


@query
def tier_normalise(spark, sf):
    return fx.archival_files(spark, sf).select(
        "id", "current_access_tier", tiers.normalise_tier(F.col("current_access_tier")).alias("tier")
    )


# ------------------------------------------------------------------------- quality


@query
def schema_diff(spark, sf):
    return quality.schema_diff(
        fx.sheets(spark, sf), "sheet_id", "header", schemas.template("Template1")
    )


@query
def template_typed(spark, sf):
    return quality.typed_rows(fx.template_rows(spark, sf), schemas.template("Template1"), strict=False)


@query
def template_rejects(spark, sf):
    return quality.typed_rejects(fx.template_rows(spark, sf), schemas.template("Template1"))


@query
def validation_counts(spark, sf):
    return quality.validation_counts(fx.table(spark, sf, "customer"), fx.CUSTOMER_RULES)


@query
def validation_by_rule(spark, sf):
    return quality.validation_by_rule(fx.table(spark, sf, "customer"), fx.CUSTOMER_RULES)


@query
def required_fields(spark, sf):
    """Metric forms built from line items; a null stands for a field left open."""
    values = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    numbers = [
        F.nullif(F.col(values[i % 4]), F.lit(float(i))).alias(name)
        for i, name in enumerate(schemas.METRIC_NUMBERS)
    ]
    note = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag"))
    forms = fx.table(spark, sf, "lineitem").select(*numbers, note.alias(schemas.METRIC_TEXT))
    return quality.validation_by_rule(forms, quality.required_rules())


@query
def mapped_projection(spark, sf):
    return quality.map_columns(
        fx.table(spark, sf, "customer"), {"c_custkey": "CustomerId", "c_name": "CustomerName"}
    )


@query
def columns_by_type(spark, sf):
    return catalog.columns_by_type(
        fx.tables(spark, sf), ("bigint", "timestamp_ntz"),
        catalog.table_list("orders,lineitem,,events,no_such_table"),
    )


@query
def binary_columns(spark, sf):
    return catalog.binary_columns(fx.tables(spark, sf))


@query
def catalog_type_map(spark, sf):
    return catalog.catalog_type_map(fx.tables(spark, sf)).orderBy("class_name", "ordinal")


# ---------------------------------------------------------------------- transforms


@query
def strict_date(spark, sf):
    parsed = dates.parse_iso_date(F.col("text"))
    return fx.date_texts(spark, sf).select(
        "id", "text", parsed.alias("parsed"), dates.format_iso_date(parsed).alias("formatted")
    )


@query
def path_date(spark, sf):
    found = paths.date_in_path(F.col("path"))
    return fx.paths(spark, sf).select(
        "id", "path", found.alias("as_of_date"),
        F.when(found.isNotNull(), schemas.EXTERNAL_TYPE).alias("date_type"),
    )


@query
def local_to_utc(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", "ts", dates.local_to_utc(F.col("ts"), "America/New_York").alias("ts_utc")
    )


@query
def convert_timestamps(spark, sf):
    """Instants of the converted tables, as microseconds, summed per day."""
    source = fx.tables(spark, sf, "orders", "events")
    done = catalog.convert_timestamps(source, "orders,events", "America/New_York")
    return (
        done["events"].select(F.lit("events").alias("table_name"), F.unix_micros("ts").alias("us"))
        .unionByName(
            done["orders"].select(
                F.lit("orders").alias("table_name"), F.unix_micros("o_orderdate").alias("us")
            )
        )
        .groupBy("table_name", F.expr("us div 86400000000").alias("utc_day"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    )


@query
def nested_json(spark, sf):
    """Customers listed under their market segment, 100 to a chunk."""
    customers = fx.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("name"), F.lower("c_mktsegment").alias("newName"),
        "c_custkey", "c_name",
    )
    item = F.struct(F.col("c_name").alias("name"), F.lower("c_name").alias("newName"))
    return documents.nested_json(
        customers, ["name", "newName"], "c_custkey", item, "columns", rows_per_chunk=100
    )


@query
def ordered_listagg(spark, sf):
    body = F.format_string("[%d] %s = %d", "c_custkey", "c_name", "c_custkey")
    customers = fx.table(spark, sf, "customer").select("c_nationkey", "c_custkey", body.alias("line"))
    return documents.ordered_text(
        customers, ["c_nationkey"], "c_custkey", F.col("line"), ",\n", rows_per_chunk=50
    )


@query
def grouped_names(spark, sf):
    names = documents.grouped_names(
        fx.table(spark, sf, "part"), ["p_brand"], "p_partkey", "p_name", rows_per_chunk=50
    )
    return names.select("p_brand", "chunk", F.array_join("names", ",").alias("names"))


@query
def json_shape(spark, sf):
    return documents.json_shape(fx.table(spark, sf, "events"), "props")


@query
def json_rename(spark, sf):
    props = T.StructType([T.StructField("k", T.LongType())])
    return fx.table(spark, sf, "events").select(
        "event_id", json.rename_json(F.col("props"), props, {"k": "metricKey"}).alias("renamed")
    )


@query
def json_camel_case(spark, sf):
    parts = fx.table(spark, sf, "part").selectExpr("p_partkey", "p_name AS PartName", "p_size AS SKUSize")
    return parts.select("p_partkey", json.camel_json(["PartName", "SKUSize"]).alias("json"))


@query
def xml_to_json(spark, sf):
    schema = T.StructType([
        T.StructField("Name", T.StringType()), T.StructField("Brand", T.StringType()),
        T.StructField("Size", T.StringType()),
    ])
    xml = F.concat(
        F.lit('<?xml version="1.0"?><Part><Name>'), "p_name", F.lit("</Name><Brand>"), "p_brand",
        F.lit("</Brand><Size>"), F.col("p_size").cast("string"), F.lit("</Size></Part>"),
    )
    parts = fx.table(spark, sf, "part").select("p_partkey", xml.alias("xml"))
    return parts.select("p_partkey", json.xml_as_json(F.col("xml"), "Part", schema).alias("json"))


LICENCE = "licen[cs]e"


@query
def text_search(spark, sf):
    found = documents.text_search(fx.table(spark, sf, "documents"), LICENCE)
    return found.select("source", "doc_id")


@query
def text_search_summary(spark, sf):
    return documents.text_search_summary(fx.table(spark, sf, "documents"), LICENCE, ["lang"])


@query
def regex_lines(spark, sf):
    return documents.matching_lines(fx.table(spark, sf, "documents"), "doc_id", r"^\s*[A-Z]")


@query
def regex_rewrite(spark, sf):
    docs = fx.table(spark, sf, "documents")
    new_name = F.concat(F.lit("word"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", text.rename_word(F.col("text"), r"the\s+(\w+)", new_name).alias("text"))


@query
def line_filter(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        text.keep_lines(F.col("text"), "The").alias("kept"),
        text.drop_blank_line_after(F.col("text"), r"[A-Za-z]\.").alias("squeezed"),
    )


@query
def inner_join_report(spark, sf):
    t = fx.tables(spark, sf, "region", "nation", "supplier")
    return documents.inner_join_report(
        t["region"].select(F.col("r_regionkey").alias("parent_key"), F.col("r_name").alias("parent_name")),
        t["nation"].select(
            F.col("n_regionkey").alias("parent_key"), F.col("n_nationkey").alias("child_key"),
            F.col("n_name").alias("child_name"),
        ),
        t["supplier"].select(
            F.col("s_nationkey").alias("child_key"), F.col("s_name").alias("object_name")
        ),
    )
