"""Exports (S9-S11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.numeric import confidence_label
from tallysheet.operators.joins import lookup_join
from tallysheet.operators.ordered import number_rows_by_range
from tallysheet.operators.review import export_order, label_map
from tallysheet.schemas import STATUS_LABELS

# Leading columns of the full export.
LEADING = ("Event", "Row", "Status", "Confidence", "Document")
FORMULA_START = r"^[=+\-@\t\r]"


def csv_cell(text: Column, escape_formulas: bool = False) -> Column:
    """Quoted only when it holds a quote, comma or line break; quotes are doubled."""
    value = text
    if escape_formulas:
        value = F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)
    doubled = F.replace(value, F.lit('"'), F.lit('""'))
    return F.when(
        value.rlike('[",\r\n]'), F.concat(F.lit('"'), doubled, F.lit('"'))
    ).otherwise(doubled)


def _lines(values: Column, escape_formulas: bool) -> Column:
    return F.array_join(F.transform(values, lambda v: csv_cell(v, escape_formulas)), ",")


def _field_lists(fields: DataFrame) -> DataFrame:
    return fields.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("sort_order", "key", "label"))).alias("_fields")
    )


def _values() -> Column:
    return F.transform(
        "_fields", lambda f: F.coalesce(F.try_element_at("data", f["key"]), F.lit(""))
    )


def full_lines(
    records: DataFrame, events: DataFrame, documents: DataFrame, fields: DataFrame,
    escape_formulas: bool = False,
) -> DataFrame:
    """One CSV line per record, and line 0 with the headers of each event.

    `line_no` follows row number, then creation (O2). Lines of an event are numbered in
    sampled ranges of that order, so neither a large event nor a row number that every
    document has is one task.
    """
    titled = lookup_join(records, events.select("event_id", "title"), "event_id", spread=["record_id"])
    named = lookup_join(titled, documents.select("document_id", "file_name"), "document_id", spread=["record_id"])
    wide = lookup_join(named, _field_lists(fields), "event_id", spread=["record_id"])
    leading = F.array(
        F.coalesce("title", F.lit("")), F.coalesce(F.col("row_number").cast("string"), F.lit("")),
        F.coalesce(F.try_element_at(label_map(STATUS_LABELS), F.col("status")), F.lit("")),
        confidence_label(F.col("confidence")), F.coalesce("file_name", F.lit("")),
    )
    numbered = number_rows_by_range(wide, ["event_id"], export_order(), "line_no")
    body = numbered.select(
        "event_id", "line_no", _lines(F.concat(leading, _values()), escape_formulas).alias("line")
    )
    headers = F.concat(F.array(*[F.lit(h) for h in LEADING]), F.transform("_fields", lambda f: f["label"]))
    head = _field_lists(fields).select(
        "event_id", F.lit(0).cast("bigint").alias("line_no"), _lines(headers, escape_formulas).alias("line")
    )
    return head.unionByName(body)


def write_full(lines: DataFrame, path: str) -> None:
    """Text files per event in line order; line breaks are CR LF."""
    ordered = lines.repartitionByRange("event_id", "line_no").sortWithinPartitions("event_id", "line_no")
    ordered.select("event_id", "line").write.mode("overwrite").partitionBy("event_id").option(
        "lineSep", "\r\n"
    ).text(path)


def sheet(records: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Data-only wide rows of one template shape; `fields` are its (key, label) pairs."""
    return records.select(
        *[F.coalesce(F.try_element_at("data", F.lit(key)), F.lit("")).alias(label) for key, label in fields]
    )


def sheet_rows(records: DataFrame, fields: DataFrame) -> DataFrame:
    """S10 for many templates: the values of each record in field order as a list."""
    wide = lookup_join(records, _field_lists(fields), "event_id", spread=["record_id"])
    return wide.select("event_id", "record_id", _values().alias("values"))


def typed_columns(fields: Sequence[tuple[str, str]]) -> list[Column]:
    """Typed projection of the data map: (key, type) pairs to columns, null where unreadable."""

    def column(key: str, kind: str) -> Column:
        text = F.try_element_at("data", F.lit(key))
        if kind == "number":
            return text.try_cast("double").alias(key)
        if kind == "signature":
            return text.try_cast("boolean").alias(key)
        if kind == "date":
            return F.try_to_date(text, "yyyy-MM-dd").alias(key)
        if kind == "multi_select":
            return F.split(text, ", ").alias(key)
        return text.alias(key)

    return [column(key, kind) for key, kind in fields]


