"""Schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(S)
BOX = T.StructType(
    [T.StructField("page", I)]
    + [T.StructField(n, D) for n in ("x", "y", "width", "height")]
    + [T.StructField("normalized", B)]
)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


STAMPS = (("created_at", TS), ("updated_at", TS))

TABLES = {
    "users": _table(("id", S), ("email", S), ("name", S), ("phone", S), *STAMPS),
    "events": _table(
        ("id", S), ("title", S), ("description", S), ("event_date", TS), ("owner_id", S), *STAMPS
    ),
    "event_memberships": _table(("id", S), ("event_id", S), ("user_id", S), ("role", S), *STAMPS),
    "attendance_templates": _table(
        ("id", S), ("event_id", S), ("name", S), ("is_default", B), *STAMPS
    ),
    "template_fields": _table(
        ("id", S), ("template_id", S), ("label", S), ("key", S), ("type", S), ("required", B),
        ("sort_order", I), ("aliases", STRINGS), ("options", STRINGS), *STAMPS,
    ),
    "attendance_documents": _table(
        ("id", S), ("event_id", S), ("file_name", S), ("file_type", S), ("file_url", S),
        ("status", S), ("raw_ocr_json", S), *STAMPS,
    ),
    "attendance_records": _table(
        ("id", S), ("event_id", S), ("document_id", S), ("reviewed_by_user_id", S),
        ("reviewed_at", TS), ("row_number", I), ("data_json", T.MapType(S, S)),
        ("confidence_score", D), ("status", S), *STAMPS,
    ),
    "attendance_record_values": _table(
        ("id", S), ("record_id", S), ("field_id", S), ("raw_value", S), ("normalized_value", S),
        ("confidence", D), ("validation_issues", STRINGS), ("bounding_box", BOX), *STAMPS,
    ),
}

# Field types, record, document and role names with their labels.
FIELD_TYPES = (
    "text", "email", "phone", "number", "signature", "date", "select", "multi_select",
)
OPTION_TYPES = ("select", "multi_select")
STATUS_LABELS = {
    "draft": "Draft",
    "needs_review": "Needs review",
    "approved": "Approved",
    "rejected": "Rejected",
}
DOCUMENT_STATUSES = ("uploaded", "processing", "extracted", "reviewed", "approved", "failed")
ROLES = ("owner", "reviewer")
