"""SQL counterparts of the registered queries, for DuckDB over the same tables.

They are written apart from the Spark code, mostly in other terms: EXISTS for joins,
plain windows for sliced numbering, lists for last-wins aggregates.
"""

from __future__ import annotations

from granary import schemas


def _values(rows: list[tuple], types: dict[int, str] | None = None) -> str:
    def literal(v, i):
        text = "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
        return f"CAST({text} AS {types[i]})" if types and i in types else text

    return ", ".join("(" + ", ".join(literal(v, i) for i, v in enumerate(r)) + ")" for r in rows)


_LIFE_COLUMNS = ", ".join(["id", "name", "is_active", "azure_policy_tag", *schemas.THRESHOLD_COLUMNS])
_CONF_COLUMNS = ", ".join(schemas.TABLE_CONFIGURATION.names)

FX = {
    "fx_feed": """
        SELECT concat_ws('|', '06', p_partkey, p_name, p_brand, p_size) AS value FROM part
        UNION ALL SELECT concat_ws('|', '07', s_suppkey, s_name, s_nationkey) FROM supplier
        UNION ALL SELECT concat_ws('|', '09', n_nationkey) FROM nation
        UNION ALL SELECT concat_ws('|', '12', c_custkey, c_name, c_nationkey, c_mktsegment, '', 'x7', 'x8')
          FROM customer
        UNION ALL SELECT concat_ws('|', '99', r_name) FROM region
        UNION ALL SELECT '  ' FROM region""",
    "fx_file_b": """
        SELECT upper(trim(CASE WHEN l_linenumber % 2 = 0 THEN ' t' || l_orderkey || ' '
                               ELSE 'T' || l_orderkey || ' ' END)) AS trade_key,
               l_linestatus = 'F' AND l_linenumber % 3 <> 0 AS passes,
               CASE l_returnflag WHEN 'A' THEN 'settle' WHEN 'R' THEN 'original' END AS kind,
               CASE WHEN l_quantity >= 10 THEN CAST(l_partkey AS VARCHAR) END AS measure,
               l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity
        FROM lineitem""",
    "fx_file_a": """
        SELECT 'D' || o_orderkey AS deal_id,
               CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 't' || o_orderkey END AS trade_id,
               o_orderpriority AS book_code, 'S' || o_custkey AS tsip, 'P' || (o_custkey % 10) AS provider_id,
               CAST(o_orderdate AS DATE) AS trade_date, CAST(o_orderdate AS DATE) AS business_date,
               CAST(o_orderdate AS DATE) + 2 AS settlement_date,
               CAST(o_totalprice AS DECIMAL(18,2)) AS buy_price
        FROM orders""",
    "fx_file": """
        SELECT o_orderkey AS id,
               CAST(CASE o_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END AS INTEGER)
                 AS table_configuration_id,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS as_of_date,
               CASE WHEN o_custkey % 3 = 1 THEN 'EXT' WHEN o_orderkey % 11 = 0 THEN 'EOY'
                    WHEN o_orderkey % 5 = 0 THEN 'EOQ' WHEN o_orderkey % 3 = 0 THEN 'EOM'
                    ELSE 'EOD' END AS date_type,
               'devstore' AS storage_account_name, 'archival' AS container_name,
               '/a/b/' || o_orderkey AS blob_path, 'e' || o_orderkey AS etag,
               'application/octet-stream' AS content_type,
               CAST(trunc(o_totalprice) AS BIGINT) AS file_size_bytes,
               o_custkey AS row_count,
               CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'Created' ELSE 'Deleted' END AS status,
               o_orderdate AS created_at_et, CAST(NULL AS VARCHAR) AS archival_policy_tag,
               CASE o_custkey % 4 WHEN 0 THEN 'hot' WHEN 1 THEN 'COOL' WHEN 2 THEN 'archive' ELSE 'Cold' END
                 AS current_access_tier,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL 10 DAY END
                 AS last_tier_check_at_et,
               CAST(CASE WHEN o_orderkey % 13 = 0 THEN 4 END AS INTEGER) AS override_file_lifecycle_policy_id,
               CAST(NULL AS TIMESTAMP) AS last_tags_sync_at_et
        FROM orders""",
    "fx_exemption": """
        SELECT * FROM (VALUES (10, DATE '1997-03-14', 'Table'), (30, NULL, 'Table'), (10, DATE '1998-10-03', 'File'))
          AS t(cfg, d, scope)""",
    "fx_path": """
        SELECT o_orderkey AS id, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m,
               strftime(o_orderdate, '%d') AS dd, o_orderkey % 4 AS kind,
               CASE o_orderkey % 4
                 WHEN 0 THEN 'external/db/t/' || y || '/' || m || '/' || dd || '/f.parquet'
                 WHEN 1 THEN 'external/t/' || y || '-' || m || '-' || dd || '/x.csv'
                 WHEN 2 THEN concat('a', chr(92), '2024', chr(92), '13', chr(92), '45', chr(92), '2024-02-30',
                                    chr(92), y, chr(92), m, chr(92), dd)
                 ELSE 'external/none/20240101.csv' END AS path
        FROM orders""",
    "fx_template": """
        SELECT CASE WHEN l_quantity = 1 THEN 'x' ELSE '' END || l_suppkey AS FundId,
               CAST(month(l_shipdate) AS VARCHAR) AS Month, CAST(year(l_shipdate) AS VARCHAR) AS Year,
               CASE WHEN l_quantity = 2 THEN '' ELSE CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) END AS Return
        FROM lineitem""",
    "life": f"SELECT * FROM (VALUES {_values(schemas.LIFECYCLE_SEED)}) AS t({_LIFE_COLUMNS})",
    "conf": f"SELECT * FROM (VALUES {_values(schemas.CONFIGURATION_SEED)}) AS t({_CONF_COLUMNS})",
    # Retention of configuration 10 (orders, policy 1) and 30 (line items, policy 3).
    "dts": """
        SELECT DISTINCT 10 AS cfg, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL
        UNION ALL
        SELECT DISTINCT 30, CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate IS NOT NULL""",
    "typed": """
        SELECT cfg, d, CASE
            WHEN d = max(d) OVER (PARTITION BY cfg, year(d))
             AND (d < max(d) OVER (PARTITION BY cfg) OR (month(d) = 12 AND day(d) = 31)) THEN 'EOY'
            WHEN d = max(d) OVER (PARTITION BY cfg, date_trunc('quarter', d))
             AND (d < max(d) OVER (PARTITION BY cfg)
                  OR d = CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) THEN 'EOQ'
            WHEN d = max(d) OVER (PARTITION BY cfg, date_trunc('month', d))
             AND (d < max(d) OVER (PARTITION BY cfg) OR d = last_day(d)) THEN 'EOM'
            ELSE 'EOD' END AS kind
        FROM dts""",
    "ranked": """
        SELECT cfg, d, kind, row_number() OVER (PARTITION BY cfg, kind ORDER BY d DESC)
          <= CASE WHEN cfg = 30 THEN 3650 WHEN kind = 'EOD' THEN 30 WHEN kind = 'EOM' THEN 12
                  WHEN kind = 'EOQ' THEN 8 ELSE 3 END AS kept
        FROM typed""",
    "decided": """
        SELECT cfg, d, kind, CASE
            WHEN EXISTS (SELECT 1 FROM fx_file f WHERE f.table_configuration_id = r.cfg AND f.status = 'Active'
                           AND f.as_of_date = r.d AND f.date_type = r.kind)
              THEN 'Already archived (archival_file exists).'
            WHEN EXISTS (SELECT 1 FROM fx_exemption e WHERE e.cfg = r.cfg AND e.scope = 'Table'
                           AND (e.d IS NULL OR e.d = r.d))
              THEN 'Table/date is exempt from archival.' END AS message
        FROM ranked r WHERE NOT kept""",
    "ship_parts": """
        SELECT CAST(l_shipdate AS DATE) AS as_of_date, l_orderkey, l_partkey,
               (row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY md5(concat_ws('|',
                  l_linenumber, l_partkey, l_suppkey, l_quantity, l_orderkey))) - 1) // 10 + 1 AS part_index
        FROM lineitem""",
    "part_plan": """
        SELECT as_of_date, part_index, count(*) AS row_count, count(*) * 100 AS file_size_bytes
        FROM ship_parts GROUP BY 1, 2""",
    "cutoffs": """
        SELECT id AS cfg, days, CAST(DATE '2000-06-30' - CAST(days AS INTEGER) AS DATE) AS cutoff_date
        FROM (SELECT c.id, (SELECT min(v) FROM (SELECT unnest([{t}]) AS v FROM life l
                              WHERE l.id = c.file_lifecycle_policy_id)) AS days FROM conf c)
        """.replace("{t}", ", ".join(f"l.{c}" for c in schemas.THRESHOLD_COLUMNS)),
    "tiered": """
        SELECT f.*, p.id AS policy_id,
               date_diff('day', coalesce(f.as_of_date, CAST(f.created_at_et AS DATE)), DATE '2000-06-30') AS age,
               CASE f.date_type WHEN 'EXT' THEN external_cool_days WHEN 'EOY' THEN eoy_cool_days
                 WHEN 'EOQ' THEN eoq_cool_days WHEN 'EOM' THEN eom_cool_days ELSE eod_cool_days END AS cool,
               CASE f.date_type WHEN 'EXT' THEN external_archive_days WHEN 'EOY' THEN eoy_archive_days
                 WHEN 'EOQ' THEN eoq_archive_days WHEN 'EOM' THEN eom_archive_days ELSE eod_archive_days END AS arch,
               CASE f.date_type WHEN 'EXT' THEN external_delete_days WHEN 'EOY' THEN eoy_delete_days
                 WHEN 'EOQ' THEN eoq_delete_days WHEN 'EOM' THEN eom_delete_days ELSE eod_delete_days END AS del,
               CASE WHEN age >= del THEN 'Delete' WHEN age >= arch THEN 'Archive'
                    WHEN age >= cool THEN 'Cool' ELSE 'Hot' END AS tier
        FROM fx_file f JOIN conf c ON c.id = f.table_configuration_id
        JOIN life p ON p.id = coalesce(f.override_file_lifecycle_policy_id, c.file_lifecycle_policy_id)""",
    "due": """
        SELECT f.*, k.cutoff_date, row_number() OVER (PARTITION BY f.table_configuration_id
                 ORDER BY f.last_tier_check_at_et NULLS FIRST, f.as_of_date NULLS FIRST, f.id) AS page_rank
        FROM fx_file f JOIN cutoffs k ON k.cfg = f.table_configuration_id
        WHERE f.status <> 'Deleted' AND (f.as_of_date <= k.cutoff_date
           OR (f.as_of_date IS NULL AND CAST(f.created_at_et AS DATE) <= k.cutoff_date)
           OR f.last_tier_check_at_et IS NULL OR f.last_tier_check_at_et <= TIMESTAMP '2000-06-29 00:00:00')""",
    "acts": """
        SELECT t.table_configuration_id, t.id AS file_id, t.storage_account_name, t.container_name, t.blob_path,
               CAST(t.age AS INTEGER) AS age_days, t.tier AS desired_tier,
               'Table=' || t.table_configuration_id || ' File=' || t.id || ' Action=TierSet(' || t.tier || ')'
                 AS action
        FROM tiered t JOIN due d ON d.id = t.id""",
}

# The same retention over months instead of days.
FX["months"] = "SELECT DISTINCT 10 AS cfg, CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders"
for _name, _base in (("typed_m", "typed"), ("ranked_m", "ranked"), ("decided_m", "decided")):
    FX[_name] = FX[_base].replace("dts", "months").replace("FROM typed", "FROM typed_m").replace(
        "FROM ranked", "FROM ranked_m")
FX["by_month"] = """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1"""

# Which fixtures build on which.
NEEDS = {
    "typed": ["dts"], "ranked": ["typed"], "decided": ["ranked", "fx_file", "fx_exemption"],
    "part_plan": ["ship_parts"], "cutoffs": ["life", "conf"], "tiered": ["fx_file", "conf", "life"],
    "typed_m": ["months"], "ranked_m": ["typed_m"], "decided_m": ["ranked_m", "fx_file", "fx_exemption"],
    "due": ["fx_file", "cutoffs"], "acts": ["tiered", "due"],
}


def _with(names: str, body: str) -> str:
    """Prefix ``body`` with the named fixtures and what they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({FX[n]})" for n in order) + "\n" + body


def _measures(where: str) -> str:
    order = "ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity"
    return f"""
        SELECT trade_key, coalesce(
            (list(measure {order}) FILTER (kind = 'settle' AND measure IS NOT NULL))[-1],
            (list(measure {order}) FILTER (kind = 'original' AND measure IS NOT NULL))[-1]) AS measure_value
        FROM fx_file_b WHERE {where} GROUP BY trade_key"""


# Columns of the given tables with their Spark types.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _columns():
    for table, text in COLUMNS.items():
        for i, item in enumerate(text.split(", "), 1):
            yield (table, i, *item.split(" "))


def _columns_by_type() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{ty}' AS data_type, {i} AS ordinal, "
        f"count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
        for t, i, c, ty in _columns()
        if t in ("orders", "lineitem", "events") and ty in ("bigint", "timestamp_ntz")
    )


def _binary_columns() -> str:
    tests = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"(SELECT count(*) FROM {t} WHERE {c} NOT IN (0, 1)) AS others"
        for t, _, c, ty in _columns() if ty == "int"
    )
    return f"SELECT table_name, column_name FROM ({tests}) WHERE others = 0"


def _catalog_type_map() -> str:
    target = {"bigint": "long", "timestamp_ntz": "DateTime"}
    rows = []
    for t, i, c, ty in _columns():
        marked = ty not in ("string", "array<float>")
        longest = f"max(length({c}))" if ty == "string" else "NULL"
        kind = "UNKNOWN_" + ty if ty.startswith("array") else target.get(ty, ty)
        rows.append(
            f"SELECT '{t[0].upper() + t[1:]}' AS class_name, '{c}' AS column_name, {i} AS ordinal, "
            f"'{ty}' AS data_type, '{kind}' AS target_type, "
            f"CASE WHEN count({c}) < count(*) AND {marked} THEN '?' ELSE '' END AS null_mark, "
            f"count({c}) = count(*) AS required, "
            f"CAST({longest} AS INTEGER) AS max_length, coalesce({longest} < 1000, false) AS declared FROM {t}"
        )
    return " UNION ALL ".join(rows)


def _required_fields() -> str:
    values = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    rows = [
        f"SELECT '{name}_required' AS rule, count(*) FILTER ({values[i % 4]} = {i}) AS rejected_rows FROM lineitem"
        for i, name in enumerate(schemas.METRIC_NUMBERS)
    ]
    rows.append(
        f"SELECT '{schemas.METRIC_TEXT}_required', count(*) FILTER (l_returnflag = 'N') FROM lineitem"
    )
    return " UNION ALL ".join(rows)


def _chunks(table: str, group: str, order: str, size: int) -> str:
    return (
        f"SELECT *, (row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1) // {size} AS chunk, "
        f"row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {table}"
    )


_VIEW = ", ".join([
    "f.id AS archival_file_id", "f.table_configuration_id", "f.as_of_date", "f.date_type",
    "f.storage_account_name AS file_storage_account_name", "f.container_name AS file_container_name",
    "f.blob_path", "f.etag", "f.content_type", "f.file_size_bytes", "f.row_count", "f.status AS file_status",
    "f.created_at_et AS file_created_at_et", "f.archival_policy_tag", "f.current_access_tier",
    "f.last_tier_check_at_et", "f.override_file_lifecycle_policy_id", "f.last_tags_sync_at_et",
    "c.database_name", "c.schema_name", "c.table_name", "c.as_of_date_column", "c.export_mode",
    "c.storage_account_name AS config_storage_account_name", "c.container_name AS config_container_name",
    "c.archive_path_template", "c.discovery_path_prefix", "c.table_retention_policy_id",
    "c.file_lifecycle_policy_id", "c.is_active AS table_configuration_is_active",
    "p.name AS file_lifecycle_policy_name", "p.azure_policy_tag AS file_lifecycle_azure_policy_tag",
    "r.name AS table_retention_policy_name", "r.is_active AS table_retention_policy_is_active",
    "r.keep_last_eod", "r.keep_last_eom", "r.keep_last_eoq", "r.keep_last_eoy",
])
_RET = f"(VALUES {_values(schemas.RETENTION_SEED)}) AS r({', '.join(schemas.RETENTION_POLICY.names)})"

_MANIFEST = """
    SELECT 10 AS table_configuration_id, as_of_date, 'EOD' AS date_type, CAST(part_index AS INTEGER) AS part_index,
           'devstore' AS storage_account_name, 'archival' AS container_name,
           '/TestDb/dbo/transactions/' || strftime(as_of_date, '%Y/%m/%d') || '.part-'
             || lpad(CAST(part_index AS VARCHAR), 5, '0') || '.parquet' AS blob_path,
           'application/octet-stream' AS content_type, file_size_bytes, row_count, 'Active' AS status,
           TIMESTAMP '2000-06-30 00:00:00' AS created_at_et, 'default-policy' AS archival_policy_tag,
           1 AS override_file_lifecycle_policy_id
    FROM part_plan"""

_RULES = {
    "balance_not_negative": "c_acctbal >= 0",
    "known_segment": "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')",
    "name_given": "regexp_matches(c_name, '\\S')",
}

_THRESHOLDS = " UNION ALL ".join(
    f"SELECT id, name, azure_policy_tag, is_active, '{kind}' AS date_type, '{action}' AS action, "
    f"{prefix}_{action}_days AS days FROM life"
    for kind, prefix in schemas.THRESHOLD_PREFIX.items() for action in schemas.TIER_ACTIONS
)

_ROUTED = """
    SELECT CASE string_split(value, '|')[1] WHEN '06' THEN 'product' WHEN '07' THEN 'inventory'
             WHEN '09' THEN 'trade' WHEN '12' THEN 'deals' WHEN '99' THEN '_unrouted' ELSE '_blank' END AS table_name,
           count(*) AS n
    FROM fx_feed GROUP BY 1"""
_SEARCH = "regexp_matches(text, '(?i)licen[cs]e')"
_LINES = "string_split_regex(text, '\\r\\n|\\r|\\n')"

ORACLES: dict[str, str] = {
    "record_type_counts": _with("fx_feed", """
        SELECT string_split(value, '|')[1] AS record_type, count(*) AS n FROM fx_feed
        WHERE trim(value) <> '' GROUP BY 1"""),
    "feed_totals": _with("fx_feed", """
        SELECT count(*) AS lines_read, count(*) FILTER (trim(value) = '') AS blank_lines,
               count(*) FILTER (value LIKE '99|%') AS unrouted_lines,
               count(*) FILTER (value LIKE '06|%') AS product_lines,
               count(*) FILTER (value LIKE '07|%') AS inventory_lines,
               count(*) FILTER (value LIKE '09|%') AS trade_lines,
               count(*) FILTER (value LIKE '12|%') AS deals_lines
        FROM fx_feed"""),
    "route_product": """
        SELECT '06' AS col1, CAST(p_partkey AS VARCHAR) AS col2, p_name AS col3, p_brand AS col4,
               CAST(p_size AS VARCHAR) AS col5 FROM part""",
    "route_inventory": """
        SELECT '07' AS col1, CAST(s_suppkey AS VARCHAR) AS col2, s_name AS col3,
               CAST(s_nationkey AS VARCHAR) AS col4 FROM supplier""",
    "route_trade": "SELECT '09' AS col1, CAST(n_nationkey AS VARCHAR) AS col2, '' AS col3 FROM nation",
    "route_deals": """
        SELECT '12' AS col1, CAST(c_custkey AS VARCHAR) AS col2, c_name AS col3,
               CAST(c_nationkey AS VARCHAR) AS col4, c_mktsegment AS col5, '' AS col6 FROM customer""",
    "unrouted_records": "SELECT '99' AS record_type, '99|' || r_name AS value FROM region",
    "measure_resolve_v1": _with("fx_file_b", _measures("true")),
    "measure_resolve_v2": _with("fx_file_b", _measures("passes")),
    "provider_deals": _with("fx_file_b fx_file_a", f"""
        SELECT a.*, m.measure_value, DATE '2000-06-30' AS created_on
        FROM fx_file_a a LEFT JOIN ({_measures('passes')}) m ON m.trade_key = upper(a.trade_id)
        WHERE a.trade_id <> ''"""),
    "scan_orders_as_of": "SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'",
    "distinct_as_of": _with("dts", "SELECT d AS as_of_date FROM dts WHERE cfg = 10"),
    "date_types": _with("typed", "SELECT cfg AS table_configuration_id, d AS as_of_date, kind AS date_type FROM typed"),
    "retention_keep": _with("ranked", """
        SELECT cfg AS table_configuration_id, d AS as_of_date, kind AS date_type FROM ranked WHERE kept"""),
    "retention_candidates": _with("ranked", """
        SELECT cfg AS table_configuration_id, d AS as_of_date, kind AS date_type FROM ranked WHERE NOT kept ORDER BY d"""),
    "archive_plan": _with("decided", """
        SELECT cfg AS table_configuration_id, d AS as_of_date, kind AS date_type FROM decided WHERE message IS NULL"""),
    "archive_decisions": _with("decided", """
        SELECT cfg AS table_configuration_id, d AS as_of_date, kind AS date_type, message,
               CASE WHEN message IS NULL THEN 'Export' ELSE 'Skipped' END AS decision FROM decided"""),
    "export_parts": _with("ship_parts", """
        SELECT as_of_date, CAST(part_index AS INTEGER) AS part_index, count(*) AS row_count,
               min(l_orderkey) AS min_orderkey, max(l_orderkey) AS max_orderkey,
               CAST(sum(l_partkey) AS BIGINT) AS partkey_sum
        FROM ship_parts GROUP BY 1, 2"""),
    "export_totals": """
        SELECT CAST(l_shipdate AS DATE) AS as_of_date, (count(*) + 9) // 10 AS part_count,
               count(*) AS row_count, count(*) * 100 AS size_bytes FROM lineitem GROUP BY 1""",
    "part_paths": _with("part_plan", _MANIFEST),
    "file_tags": _with("part_plan", f"""
        SELECT blob_path, kv[1] AS tag, kv[2] AS tag_value FROM (
          SELECT blob_path, unnest([
            ['archival_table_configuration_id', '10'], ['archival_policy', 'default-policy'],
            ['archival_exempt', CASE WHEN as_of_date = DATE '1998-10-03' THEN 'true' ELSE 'false' END],
            ['archival_date', strftime(as_of_date, '%Y-%m-%d')], ['archival_date_type', 'EOD'],
            ['archival_part_index', CAST(part_index AS VARCHAR)]]) AS kv
          FROM ({_MANIFEST}))"""),
    "run_detail_plan": _with("decided", """
        , counted AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
        SELECT CAST(77 AS BIGINT) AS run_id, 10 AS table_configuration_id, d AS as_of_date, kind AS date_type,
               'Export' AS phase, CASE WHEN message IS NULL THEN 'Success' ELSE 'Skipped' END AS status,
               CASE WHEN message IS NULL THEN n ELSE 0 END AS rows_affected,
               CASE WHEN message IS NULL AND n <= 8 THEN '/p/' || CAST(d AS VARCHAR) END AS file_path,
               message AS error_message
        FROM decided JOIN counted USING (d)
        UNION ALL
        SELECT 77, 10, d, kind, 'Delete', 'Success', CASE WHEN day(d) = 1 THEN n - 1 ELSE n END, NULL,
               CASE WHEN day(d) = 1 THEN 'ExpectedDeleteCount=' || n || ',ActualDeleted=' || (n - 1) END
        FROM decided JOIN counted USING (d) WHERE message IS NULL"""),
    "upsert_files": _with("fx_file", """
        , versions AS (
          SELECT *, created_at_et AS updated_at, 0 AS fresh FROM fx_file
          UNION ALL SELECT * REPLACE ('Created' AS status), created_at_et, 0 FROM fx_file WHERE status <> 'Deleted'
          UNION ALL SELECT * REPLACE (file_size_bytes + 1 AS file_size_bytes), created_at_et + INTERVAL 1 HOUR, 1
            FROM fx_file WHERE status = 'Active')
        SELECT table_configuration_id, as_of_date, blob_path, status, file_size_bytes, updated_at
        FROM versions QUALIFY row_number() OVER (PARTITION BY table_configuration_id, as_of_date, blob_path
          ORDER BY updated_at DESC, fresh DESC, status DESC, file_size_bytes DESC) = 1"""),
    "delete_survivors": """
        SELECT * FROM orders WHERE o_orderdate IS NULL OR CAST(o_orderdate AS DATE) <> DATE '1998-10-03'""",
    "delete_reconcile": """
        SELECT d AS as_of_date, n AS actual_rows, n + bump AS expected_rows, 'Success' AS status,
               CASE WHEN bump = 1 THEN 'ExpectedDeleteCount=' || (n + 1) || ',ActualDeleted=' || n END AS error_message
        FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n,
                     CASE WHEN CAST(o_orderdate AS DATE) = DATE '1998-10-03' THEN 1 ELSE 0 END AS bump
              FROM orders GROUP BY 1)""",
    "policy_unpivot": _with("tiered", f"""
        SELECT t.id AS policy_id, t.name, t.azure_policy_tag, t.is_active, t.date_type, t.action, t.days,
               g.files
        FROM ({_THRESHOLDS}) t
        LEFT JOIN (SELECT policy_id, date_type, count(*) AS files FROM tiered GROUP BY 1, 2) g
          ON g.policy_id = t.id AND g.date_type = t.date_type"""),
    "policy_cutoff": _with("cutoffs fx_file", """
        SELECT cfg AS table_configuration_id, days AS min_days, cutoff_date,
               (SELECT count(*) FROM fx_file f WHERE f.table_configuration_id = cfg
                  AND coalesce(f.as_of_date, CAST(f.created_at_et AS DATE)) <= cutoff_date) AS files_due
        FROM cutoffs"""),
    "lifecycle_candidates": _with("due", """
        SELECT table_configuration_id, id, as_of_date, last_tier_check_at_et, cutoff_date,
               CAST(page_rank AS INTEGER) AS page_rank FROM due WHERE page_rank <= 500"""),
    "desired_tier": _with("tiered", """
        SELECT id, table_configuration_id, date_type, policy_id, CAST(age AS INTEGER) AS age_days,
               tier AS desired_tier FROM tiered"""),
    "lifecycle_actions": _with("acts", "SELECT * FROM acts"),
    "lifecycle_summary": _with("acts", """
        SELECT table_configuration_id, desired_tier, count(*) AS files FROM acts GROUP BY 1, 2"""),
    "file_full_view": _with("fx_file conf life", f"""
        SELECT {_VIEW} FROM fx_file f LEFT JOIN conf c ON c.id = f.table_configuration_id
        LEFT JOIN life p ON p.id = c.file_lifecycle_policy_id
        LEFT JOIN {_RET} ON r.id = c.table_retention_policy_id"""),
    "tier_normalise": _with("fx_file", """
        SELECT id, current_access_tier, CASE lower(current_access_tier) WHEN 'hot' THEN 'Hot' WHEN 'cool' THEN 'Cool'
          WHEN 'archive' THEN 'Archive' ELSE current_access_tier END AS tier FROM fx_file"""),
    "schema_diff": """
        SELECT o_orderkey AS sheet_id, side, "column" FROM orders JOIN (VALUES
          (0, 'missing', 'Year'), (0, 'missing', 'Return'), (0, 'extra', 'Returns'), (0, 'extra', 'Extra'),
          (2, 'missing', 'Return'), (2, 'extra', 'return')) AS v(k, side, "column") ON o_orderkey % 3 = k""",
    "template_typed": _with("fx_template", """
        SELECT CAST(FundId AS INTEGER) AS FundId, CAST(Month AS INTEGER) AS Month, CAST(Year AS INTEGER) AS Year,
               CAST(Return AS DOUBLE) AS Return
        FROM fx_template WHERE FundId NOT LIKE 'x%' AND Return <> ''"""),
    "template_rejects": _with("fx_template", """
        SELECT *, CASE WHEN FundId LIKE 'x%' THEN 'FundId' ELSE 'Return' END AS bad_columns
        FROM fx_template WHERE FundId LIKE 'x%' OR Return = ''"""),
    "validation_counts": f"""
        SELECT count(*) AS total_rows, count(*) FILTER (NOT coalesce({' AND '.join(_RULES.values())}, false))
          AS rejected_rows FROM customer""",
    "validation_by_rule": " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({r}, false)) AS rejected_rows FROM customer"
        for n, r in _RULES.items()),
    "required_fields": _required_fields(),
    "mapped_projection": "SELECT c_custkey AS CustomerId, c_name AS CustomerName FROM customer",
    "columns_by_type": _columns_by_type(),
    "binary_columns": _binary_columns(),
    "catalog_type_map": _catalog_type_map(),
    "strict_date": """
        SELECT o_orderkey AS id,
               CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2024-1-5'
                 WHEN 2 THEN '2024-02-30' WHEN 3 THEN '' END AS text,
               CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) END AS parsed,
               CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS formatted
        FROM orders""",
    "path_date": _with("fx_path", """
        SELECT id, path, CASE WHEN kind < 3 THEN CAST(y || '-' || m || '-' || dd AS DATE) END AS as_of_date,
               CASE WHEN kind < 3 THEN 'EXT' END AS date_type FROM fx_path"""),
    "local_to_utc": """
        SELECT event_id, ts, timezone('UTC', timezone('America/New_York', ts)) AS ts_utc FROM events""",
    "convert_timestamps": """
        SELECT table_name, us // 86400000000 AS utc_day, count(*) AS n, min(us) AS first_us, max(us) AS last_us
        FROM (SELECT 'events' AS table_name, epoch_us(timezone('America/New_York', ts)) AS us FROM events
              UNION ALL
              SELECT 'orders', epoch_us(timezone('America/New_York', o_orderdate)) FROM orders)
        GROUP BY 1, 2""",
    "nested_json": f"""
        SELECT c_mktsegment AS name, lower(c_mktsegment) AS "newName", chunk, CAST(count(*) AS INTEGER) AS items,
               CAST(json_object('name', c_mktsegment, 'newName', lower(c_mktsegment), 'columns',
                 to_json(list(json_object('name', c_name, 'newName', lower(c_name)) ORDER BY rn))) AS VARCHAR) AS json
        FROM ({_chunks('customer', 'c_mktsegment', 'c_custkey', 100)}) GROUP BY c_mktsegment, chunk""",
    "ordered_listagg": f"""
        SELECT c_nationkey, chunk, string_agg('[' || c_custkey || '] ' || c_name || ' = ' || c_custkey,
                 ',' || chr(10) ORDER BY rn) AS body
        FROM ({_chunks('customer', 'c_nationkey', 'c_custkey', 50)}) GROUP BY 1, 2""",
    "grouped_names": f"""
        SELECT p_brand, chunk, string_agg(p_name, ',' ORDER BY rn) AS names
        FROM ({_chunks('part', 'p_brand', 'p_partkey', 50)}) GROUP BY 1, 2""",
    "json_shape": """
        SELECT path, CASE kind WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                 WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' ELSE 'object' END AS kind,
               count(*) AS n
        FROM (SELECT path, json_type(props, '$.' || path) AS kind
              FROM (SELECT props, unnest(json_keys(props)) AS path FROM events))
        GROUP BY 1, 2""",
    "json_rename": """
        SELECT event_id, '{"metricKey":' || json_extract_string(props, '$.k') || '}' AS renamed FROM events""",
    "json_camel_case": """
        SELECT p_partkey, '{"partName":"' || p_name || '","skuSize":' || p_size || '}' AS json FROM part""",
    "xml_to_json": """
        SELECT p_partkey, '{"Part":{"Name":"' || p_name || '","Brand":"' || p_brand || '","Size":"' || p_size
          || '"}}' AS json FROM part""",
    "text_search": f"SELECT source, doc_id FROM documents WHERE {_SEARCH}",
    "text_search_summary": f"""
        SELECT lang, count(*) AS scanned, count(*) FILTER ({_SEARCH}) AS matching FROM documents GROUP BY 1""",
    "regex_lines": f"""
        SELECT * FROM (SELECT doc_id, CAST(unnest(generate_series(0, len({_LINES}) - 1)) AS INTEGER) AS line_no,
                              unnest({_LINES}) AS line FROM documents)
        WHERE regexp_matches(line, '^\\s*[A-Z]')""",
    "regex_rewrite": """
        SELECT doc_id, CASE WHEN word = '' OR word = fresh THEN text
                 ELSE regexp_replace(text, '(?i)\\b' || word || '\\b', fresh, 'g') END AS text
        FROM (SELECT doc_id, text, regexp_extract(text, '(?i)the\\s+(\\w+)', 1) AS word,
                     'word' || doc_id AS fresh FROM documents)""",
    "line_filter": """
        SELECT doc_id, coalesce(array_to_string(list_filter(string_split_regex(text, '\\r?\\n'),
                 lambda x: regexp_matches(x, '^\\s*The')), chr(10)), '') AS kept,
               regexp_replace(text, '([A-Za-z]+\\.\\r?\\n)\\r?\\n', '\\1', 'g') AS squeezed
        FROM documents""",
    "inner_join_report": """
        SELECT r_name AS parent_name, n_name AS child_name, s_name AS object_name
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
        ORDER BY 1, 2, 3""",
    # Queries that write and read back.
    "write_parts": """
        SELECT d AS as_of_date, CAST(part AS INTEGER) AS part_index, least(2000, n - 2000 * (part - 1)) AS row_count
        FROM (SELECT d, n, unnest(generate_series(1, (n + 1999) // 2000)) AS part
              FROM (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1))""",
    "read_parts": "SELECT * FROM orders",
    "archive_job": _with("decided_m by_month", """
        SELECT CAST(77 AS BIGINT) AS run_id, 10 AS table_configuration_id, d AS as_of_date, kind AS date_type,
               'Export' AS phase, CASE WHEN message IS NULL THEN 'Success' ELSE 'Skipped' END AS status,
               CASE WHEN message IS NULL THEN n ELSE 0 END AS rows_affected,
               CASE WHEN message IS NULL AND n <= 1000 THEN '/TestDb/dbo/transactions/'
                 || strftime(d, '%Y/%m/%d') || '.part-00001.parquet' END AS file_path,
               message AS error_message
        FROM decided_m JOIN by_month USING (d)
        UNION ALL
        SELECT 77, 10, d, kind, 'Delete', 'Success', n, NULL, NULL
        FROM decided_m JOIN by_month USING (d) WHERE message IS NULL"""),
    "archive_job_survivors": _with("decided_m by_month", """
        SELECT d AS as_of_date, n FROM by_month
        WHERE d NOT IN (SELECT d FROM decided_m WHERE message IS NULL)"""),
    "ingest_job": _with("fx_feed", _ROUTED),
    "stream_ingest": _with("fx_feed", _ROUTED),
    "tee_archive": _with("fx_feed", "SELECT value FROM fx_feed"),
    "stream_discovery_job": """
        SELECT DISTINCT 20 AS table_configuration_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of_date,
               'EXT' AS date_type, 'Active' AS status, CAST(1 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS sized
        FROM orders""",
    "staging_job": _with("fx_template", """
        SELECT CAST(Year AS INTEGER) AS year, CAST(Month AS INTEGER) AS month, 2 * count(*) AS n,
               CAST(2 * sum(CAST(FundId AS INTEGER)) AS BIGINT) AS fund_id_sum
        FROM fx_template WHERE FundId NOT LIKE 'x%' AND Return <> '' GROUP BY 1, 2"""),
    "rollback_job": "SELECT DATE '2000-06-30' AS created_on, CAST(1 AS BIGINT) AS run_id, count(*) AS n FROM orders",
    "untyped_sheets": _with("fx_template", """
        SELECT FundId, count(*) AS n, count(*) FILTER (Return <> '') AS returns FROM fx_template GROUP BY 1"""),
}
ORACLES["provider_deals_job"] = ORACLES["provider_deals"]
ORACLES["lifecycle_job"] = ORACLES["lifecycle_actions"]

ORACLES |= {
    "staging_rejects": _with("fx_template", """
        SELECT t.*, CASE WHEN FundId LIKE 'x%' THEN 'FundId' ELSE 'Return' END AS bad_columns
        FROM fx_template t, (VALUES (1), (2)) AS loads(n) WHERE FundId LIKE 'x%' OR Return = ''"""),
    "stream_tee": ORACLES["tee_archive"],
    "stream_batch_hook": _with("fx_feed", "SELECT CAST(count(*) AS BIGINT) AS n, true AS several FROM fx_feed"),
    "object_listing": """
        SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of_date, 'EXT' AS date_type,
               CAST(1 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS sized FROM orders""",
    "scan_files": "SELECT * FROM supplier",
    "scan_catalog": "SELECT * FROM supplier",
    "json_array_files": "SELECT p_partkey, p_name, p_size FROM part",
    "json_file": """
        SELECT '{"o_orderkey":' || o_orderkey || ',"priority":' ||
               CASE WHEN o_orderpriority = '5-LOW' OR o_orderpriority IS NULL THEN 'null'
                    ELSE '"' || o_orderpriority || '"' END || '}' AS value FROM orders""",
    "tsv_report": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "empty_part": f"""
        SELECT CAST(1 AS BIGINT) AS files, '{','.join(c.split()[0] for c in COLUMNS['orders'].split(', '))}' AS columns, (SELECT count(*) FROM orders WHERE o_orderkey < 0) AS rows""",
    "archived_inputs": """
        SELECT 'FileA_20000630_000000.csv' AS name, count(*) AS n FROM orders
        UNION ALL SELECT 'FileB_20000630_000000.csv', count(*) FROM nation""",
    "file_stamps": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
    "default_date_type": _with("typed", """
        SELECT 10 AS table_configuration_id, s.d AS as_of_date, coalesce(t.kind, 'EOD') AS date_type
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) s
        LEFT JOIN (SELECT d, kind FROM typed WHERE cfg = 10) t ON t.d = s.d"""),
    "json_shape_nested": """
        SELECT path, kind, (SELECT count(*) FROM orders) AS n FROM (VALUES ('key', 'int'), ('order', 'object'),
          ('order.total', 'double'), ('order.state', 'object'), ('order.state.status', 'string')) AS t(path, kind)""",
    "catalog_profile": """
        SELECT 'labels' AS table_name, c AS column_name, 5 AS listed, 9 AS mapped
        FROM (SELECT 'quality' AS c, max(quality) AS top FROM labels UNION ALL SELECT 'toxic', max(toxic) FROM labels)
        WHERE top <= 1""",
    "repeated_hour": """
        SELECT o_orderkey, TIMESTAMP '2024-04-06 15:00:00' + INTERVAL 1 MINUTE * CAST(o_orderkey % 30 AS INTEGER) AS utc
        FROM orders""",
}

# Archival of documents by day.
FX["doc_days"] = "SELECT DISTINCT 10 AS cfg, CAST(DATE '1996-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS d FROM documents"
for _name, _base in (("typed_d", "typed"), ("ranked_d", "ranked"), ("decided_d", "decided")):
    FX[_name] = FX[_base].replace("dts", "doc_days").replace("FROM typed", "FROM typed_d").replace("FROM ranked", "FROM ranked_d")
FX["by_day"] = "SELECT CAST(DATE '1996-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS d, count(*) AS n FROM documents GROUP BY 1"
NEEDS |= {"typed_d": ["doc_days"], "ranked_d": ["typed_d"], "decided_d": ["ranked_d", "fx_file", "fx_exemption"]}
FX["doc_file"] = """
    SELECT CAST(10 * (1 + doc_id % 3) AS INTEGER) AS table_configuration_id, doc_id,
           CASE WHEN doc_id % 11 <> 0 THEN CAST(DATE '1996-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) END AS as_of_date,
           '/d/' || doc_id AS blob_path, CAST(n_chars AS BIGINT) AS file_size_bytes FROM documents"""
_CELLS = "SELECT doc_id, CAST(n_chars AS INTEGER) AS n_chars, source FROM documents WHERE doc_id % 7 <> 3"
_LIVE = """
    SELECT * FROM (SELECT doc_id, source, lang, n_chars, CAST(DATE '1996-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS as_of_date
                   FROM documents) WHERE day(as_of_date) > 10 AND n_chars >= 500"""

ORACLES |= {
    "archive_resume": _with("decided_d by_day", """
        SELECT CAST(77 AS BIGINT) AS run_id, 10 AS table_configuration_id, d AS as_of_date, kind AS date_type,
               'Export' AS phase, CASE WHEN message IS NULL THEN 'Success' ELSE 'Skipped' END AS status,
               CASE WHEN message IS NULL THEN n ELSE 0 END AS rows_affected,
               CASE WHEN message IS NULL AND n <= 1000 THEN '/TestDb/dbo/transactions/'
                 || strftime(d, '%Y/%m/%d') || '.part-00001.parquet' END AS file_path,
               message AS error_message
        FROM decided_d JOIN by_day USING (d)
        UNION ALL
        SELECT 77, 10, d, kind, 'Delete', 'Success', n, NULL, NULL
        FROM decided_d JOIN by_day USING (d) WHERE message IS NULL"""),
    "archive_resume_rows": _with("decided_d", """
        SELECT doc_id, n_chars, d AS as_of_date, CASE WHEN d IN (SELECT d FROM decided_d WHERE message IS NULL) THEN 'moved' ELSE 'left' END AS place
        FROM (SELECT doc_id, n_chars, CAST(DATE '1996-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS d FROM documents)"""),
    "file_table_merge": _with("doc_file", """
        , first_ids AS (SELECT doc_id, row_number() OVER (ORDER BY as_of_date NULLS FIRST, table_configuration_id, blob_path) AS id
                        FROM doc_file WHERE doc_id % 2 = 0),
        more_ids AS (SELECT doc_id, (SELECT count(*) FROM first_ids) +
                       row_number() OVER (ORDER BY as_of_date NULLS FIRST, table_configuration_id, blob_path) AS id
                     FROM doc_file WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0)
        SELECT id, table_configuration_id, as_of_date, blob_path, file_size_bytes + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS file_size_bytes,
               'Active' AS status, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2000-01-02' ELSE TIMESTAMP '2000-01-01' END AS created_at_et
        FROM doc_file JOIN (FROM first_ids UNION ALL FROM more_ids) USING (doc_id)"""),
    "snapshot_rollback": f"""
        SELECT *, 1 AS copies FROM ({_CELLS}) UNION ALL SELECT d.*, 2 FROM ({_CELLS}) d, range(2)""",
    "snapshot_rejects": """
        SELECT CAST(doc_id AS VARCHAR) AS DocId, 'n/a' AS Chars, source AS Source, 'Chars' AS bad_columns FROM documents WHERE doc_id % 7 = 3""",
    "snapshot_counts": """
        SELECT CAST(v AS INTEGER) AS version, CAST(t * (SELECT count(*) FROM documents) AS BIGINT) AS total_rows,
               CAST(t * (SELECT count(*) FROM documents WHERE doc_id % 7 = 3 OR n_chars >= 5000) AS BIGINT) AS rejected_rows
        FROM (VALUES (1, 1), (2, 2), (3, 1)) AS x(v, t)""",
    "delete_by_position": _LIVE,
    "delete_merged": _LIVE,
    "object_refresh": """
        SELECT row_number() OVER (ORDER BY d) AS id, 20 AS table_configuration_id, d AS as_of_date, 'EXT' AS date_type, 'Active' AS status,
               CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) * CASE WHEN dayofweek(d) = 0 THEN 2 ELSE 1 END AS BIGINT) AS file_size_bytes
        FROM (SELECT doc_id, CAST(DATE '1996-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS d FROM documents) GROUP BY d""",
    "deal_rejects": """
        SELECT 'D' || doc_id AS deal_id, CASE WHEN doc_id % 17 <> 5 AND doc_id % 19 <> 5 THEN CAST(n_chars AS VARCHAR) END AS measure_value,
               CASE WHEN doc_id % 17 <> 5 AND doc_id % 19 <> 5 THEN 'loaded' ELSE 'aside' END AS place FROM documents""",
    "json_array_lines": "SELECT source, doc_id, lang, n_chars FROM documents",
    "distinct_as_of_folders": "SELECT DISTINCT CAST(DATE '1996-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS as_of_date FROM documents",
    "tsv_documents": "SELECT doc_id, source, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents",
}
