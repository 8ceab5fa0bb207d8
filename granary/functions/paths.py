"""Archive paths, part names, tags, and the date hidden in a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.dates import format_iso_date, parse_iso_date


# Whole segments only: three of them as yyyy/MM/dd, or one as yyyy-MM-dd.
_SEPARATOR = r"[/\\]+"
_DATED = (
    r"(?<![^/\\])("
    rf"[0-9]{{4}}{_SEPARATOR}[0-9]{{2}}{_SEPARATOR}[0-9]{{2}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
    r")(?![^/\\])"
)


def date_in_path(path: Column) -> Column:
    """First real date spelled by the path's segments; impossible ones are passed over."""
    spelled = F.regexp_extract_all(path, F.lit(_DATED), F.lit(1))
    dates = F.transform(spelled, lambda x: parse_iso_date(F.regexp_replace(x, _SEPARATOR, "-")))
    return F.try_element_at(F.array_compact(dates), F.lit(1))


def expand_template(
    template: Column, database: Column, schema: Column, table: Column, as_of: Column
) -> Column:
    # The placeholders of a path template.
    values = {
        "{db}": database,
        "{schema}": schema,
        "{table}": table,
        "{yyyy}": F.date_format(as_of, "yyyy"),
        "{MM}": F.date_format(as_of, "MM"),
        "{dd}": F.date_format(as_of, "dd"),
    }
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit(name), value)
    return out


def part_path(base: Column, part_index: Column) -> Column:
    return F.format_string("%s.part-%05d.parquet", base, part_index)


def file_tags(
    config_id: Column,
    as_of: Column,
    date_type: Column,
    policy_tag: Column,
    exempt: Column,
    part_index: Column | None = None,
) -> Column:
    """Tag map of one archived file; date, type and part keys only when known."""
    # The tag names.
    pairs = {
        "archival_table_configuration_id": config_id.cast("string"),
        "archival_policy": F.coalesce(policy_tag, F.lit("")),
        "archival_exempt": F.when(exempt, "true").otherwise("false"),
        "archival_date": format_iso_date(as_of),
        "archival_date_type": date_type,
    }
    if part_index is not None:
        pairs["archival_part_index"] = part_index.cast("string")
    flat = [item for key, value in pairs.items() for item in (F.lit(key), value)]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())
