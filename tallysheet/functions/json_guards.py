"""Guards over loosely typed JSON (P5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALAR = r"^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$"


def scalar_entries(json_text: Column) -> Column:
    """A JSON object as MAP<STRING,STRING> of its scalar entries; null for other JSON.

    Nested values are dropped, JSON null stays as a null value.
    """
    parsed = F.try_parse_json(json_text)
    entries = F.when(
        F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast("map<string,variant>")
    )
    scalars = F.map_filter(entries, lambda k, v: F.schema_of_variant(v).rlike(SCALAR))
    return F.transform_values(scalars, lambda k, v: v.cast("string"))


def string_items(json_text: Column) -> Column:
    """A JSON array as ARRAY<STRING> of its string items; an empty array for other JSON."""
    parsed = F.try_parse_json(json_text)
    items = F.when(
        F.schema_of_variant(parsed).startswith("ARRAY"), parsed.cast("array<variant>")
    )
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(
        F.transform(strings, lambda v: v.cast("string")), F.array().cast("array<string>")
    )
