"""Review state and row creation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import redact_text
from tallysheet.operators.joins import lookup_join
from tallysheet.operators.storage import upsert_by_key
from tallysheet.schemas import FIELD_TYPES, OPTION_TYPES, STATUS_LABELS

LOW = 0.75


def label_map(labels: dict[str, str]) -> Column:
    """Constant lookup as a literal map."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])


def initial_status(given: Column, confidence: Column) -> Column:
    """T1."""
    score = F.coalesce(confidence, F.lit(1.0))
    return F.coalesce(given, F.when(score < LOW, "needs_review").otherwise("draft"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One decision per record, the last by time and then by decision_id."""
    return decisions.groupBy("record_id").agg(
        F.max_by(
            F.struct("status", "user_id", "decided_at"), F.struct("decided_at", "decision_id")
        ).alias("d")
    ).select("record_id", F.col("d.status").alias("_status"), F.col("d.user_id").alias("_user"),
             F.col("d.decided_at").alias("_at"))


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve and reject stamp reviewer and time, any other status clears both."""
    joined = records.join(latest_decisions(decisions), "record_id", "left")
    decided, final = F.col("_status").isNotNull(), F.col("_status").isin("approved", "rejected")
    return joined.select(
        *[c for c in records.columns if c not in ("status", "reviewed_by", "reviewed_at")],
        F.coalesce("_status", "status").alias("status"),
        F.when(final, F.col("_user")).when(~decided, F.col("reviewed_by")).alias("reviewed_by"),
        F.when(final, F.col("_at")).when(~decided, F.col("reviewed_at")).alias("reviewed_at"),
    )


def project_to_template(data: Column, keys: Column) -> Column:
    """Exactly the template keys, empty text where the map has nothing."""
    return F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k, F.coalesce(F.try_element_at(data, k), F.lit(""))))
    )


def apply_cell_edits(records: DataFrame, cells: DataFrame, edits: DataFrame, fields: DataFrame,
                     latest: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """An edited record is projected to its template and every template cell rewritten.

    `edits`: record_id, data and the columns of `latest`, by which the last edit of a record
    wins; `fields`: template rows with event_id, field_id, key.
    """
    edits = edits.groupBy("record_id").agg(F.max_by("data", F.struct(*latest)).alias("data"))
    template = fields.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("sort_order", "field_id", "key"))).alias("_fields")
    )
    touched = lookup_join(
        records.select("record_id", "event_id").join(edits, "record_id"), template, "event_id",
        how="inner", spread=["record_id"],
    )
    rewritten = touched.select(
        "record_id", F.explode("_fields").alias("f"), F.col("data").alias("_data")
    ).select(
        "record_id", F.col("f.field_id").alias("field_id"),
        F.coalesce(F.try_element_at("_data", F.col("f.key")), F.lit("")).alias("value"),
    ).select(
        "record_id", "field_id", F.col("value").alias("raw_value"),
        F.col("value").alias("normalized_value"), F.lit(1.0).alias("confidence"),
        F.array().cast("array<string>").alias("issues"),
    )
    projected = touched.select(
        "record_id",
        project_to_template(F.col("data"), F.transform("_fields", lambda f: f["key"])).alias("_new"),
    )
    new_records = records.join(projected, "record_id", "left").select(
        *[c for c in records.columns if c not in ("data", "confidence")],
        F.coalesce("_new", "data").alias("data"),
        F.when(F.col("_new").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )
    return new_records, upsert_by_key(
        cells, rewritten.select(*cells.columns), ["record_id", "field_id"], [F.col("raw_value")])


def reopen_on_edit(records: DataFrame, edits: DataFrame) -> DataFrame:
    """T4: an edited approved or rejected row needs review again."""
    edited = edits.select("record_id").distinct().withColumn("_edited", F.lit(True))
    again = F.col("_edited").isNotNull() & F.col("status").isin("approved", "rejected")
    return records.join(edited, "record_id", "left").withColumn(
        "status", F.when(again, "needs_review").otherwise(F.col("status"))
    ).select(*records.columns)


def create_records(rows: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record and one cell per template field for each submitted row.

    `rows`: record_id, event_id, position, row_number, data, confidence, status.
    """
    template = fields.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("sort_order", "field_id", "key"))).alias("_fields")
    )
    filled = lookup_join(rows, template, "event_id", spread=["record_id"])
    score = F.coalesce("confidence", F.lit(1.0))
    records = filled.select(
        "record_id", "event_id",
        F.coalesce("row_number", "position").cast("int").alias("row_number"),
        initial_status(F.col("status"), F.col("confidence")).alias("status"),
        score.alias("confidence"),
        project_to_template(F.col("data"), F.transform("_fields", lambda f: f["key"])).alias("data"),
    )
    cells = filled.select(
        "record_id", score.alias("confidence"), "data", F.explode("_fields").alias("f")
    ).select(
        "record_id", F.col("f.field_id").alias("field_id"),
        F.coalesce(F.try_element_at("data", F.col("f.key")), F.lit("")).alias("normalized_value"),
        "confidence",
    )
    return records, cells


def page_plan(documents: DataFrame) -> DataFrame:
    """One task row per page, request clamped to the document."""
    total = F.greatest(F.lit(1), F.coalesce("total_pages", F.lit(1)))
    planned = documents.withColumn("total_pages", total).withColumn(
        "page_start", F.least(F.coalesce("page_start", F.lit(1)), F.col("total_pages"))
    )
    planned = planned.withColumn(
        "page_count",
        F.least(
            F.coalesce("page_count", F.lit(1)),
            F.greatest(F.lit(1), F.col("total_pages") - F.col("page_start") + 1),
        ),
    )
    return planned.withColumn(
        "page",
        F.explode(F.sequence(F.col("page_start"), F.col("page_start") + F.col("page_count") - 1)),
    )


def search_records(records: DataFrame, query: str, wanted: str = "all") -> DataFrame:
    """P3 over records with row_number, status, file_name and the data map."""
    needle = query.strip().lower()
    kept = records if wanted == "all" else records.filter(F.col("status") == wanted)
    if not needle:
        return kept
    texts = F.concat(
        F.array(
            F.col("row_number").cast("string"),
            F.coalesce(F.element_at(label_map(STATUS_LABELS), F.col("status")), F.lit("")),
            F.col("file_name"),
        ),
        F.coalesce(F.map_values("data"), F.array().cast("array<string>")),
    )
    return kept.filter(
        F.exists(texts, lambda t: F.contains(F.lower(F.coalesce(t, F.lit(""))), F.lit(needle)))
    )


def attention_cells(cells: DataFrame) -> DataFrame:
    """P10."""
    return cells.filter((F.col("confidence") < LOW) | (F.size("issues") > 0))


def record_details(records: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """Records with document and reviewer columns; both sides are optional."""
    docs = documents.select("document_id", "file_name")
    people = users.select(F.col("user_id").alias("reviewed_by"), F.col("name").alias("reviewer_name"))
    return lookup_join(
        lookup_join(records, docs, "document_id", spread=["record_id"]),
        people, "reviewed_by", spread=["record_id"],
    )


def cells_with_fields(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Cells with the key, type and place of their field."""
    described = fields.select("field_id", "key", "type", "sort_order")
    return lookup_join(
        cells.drop("key", "type", "sort_order"), described, "field_id", "inner", spread=["record_id"]
    )


def record_view(records: DataFrame, documents: DataFrame, users: DataFrame, cells: DataFrame,
                fields: DataFrame) -> DataFrame:
    """Record, document and reviewer with the cells in field order.

    A record has at most one cell per field and a template at most 80 fields, so the
    cell list of a record is small.
    """
    listed = cells_with_fields(cells, fields).groupBy("record_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("sort_order", "key", "normalized_value", "confidence", "issues")
            )
        ).alias("cells")
    )
    return record_details(records, documents, users).join(listed, "record_id", "left")


# Limits of submitted rows, fields and events.
MAX_BATCH, MAX_FIELDS, MAX_ALIASES, MAX_OPTIONS, MAX_LABEL = 250, 80, 20, 50, 80
MAX_TITLE, MAX_DESCRIPTION = 120, 1000
#: Columns that must not be null.
REQUIRED = ("title", "label", "key", "type")


def _reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Codes of the broken rules; a rule that is null counts as kept, but for required columns."""
    checks = [F.when(~(F.coalesce(ok, F.lit(False)) if code in REQUIRED else ok), F.lit(code)) for code, ok in rules]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def validate_records(rows: DataFrame) -> DataFrame:
    """P11 for submitted rows; `batch_size` is the row count of their request."""
    return _reasons(rows, [
        ("row_number", F.col("row_number") >= 1),
        ("confidence", F.col("confidence").between(0, 1)),
        ("status", F.col("status").isin(*STATUS_LABELS)),
        ("batch_size", F.col("batch_size") <= MAX_BATCH),
    ])


def validate_fields(fields: DataFrame) -> DataFrame:
    """P11 for declared fields; `field_count` is the field count of their template."""
    return _reasons(fields, [
        ("label", F.length("label").between(1, MAX_LABEL)),
        ("key", F.length("key").between(1, MAX_LABEL)),
        ("type", F.col("type").isin(*FIELD_TYPES)),
        ("sort_order", F.col("sort_order") >= 0),
        ("aliases", F.size("aliases") <= MAX_ALIASES),
        ("options", F.size("options") <= MAX_OPTIONS),
        ("field_count", F.col("field_count") <= MAX_FIELDS),
    ])


def validate_events(events: DataFrame) -> DataFrame:
    return _reasons(events, [
        ("title", F.length("title").between(1, MAX_TITLE)),
        ("description", F.length("description") <= MAX_DESCRIPTION),
    ])


def field_defaults(fields: DataFrame) -> DataFrame:
    """P12. `position` counts the fields of a template from 0."""
    empty = F.array().cast("array<string>")
    return fields.withColumns({
        "required": F.coalesce("required", F.lit(False)),
        "sort_order": F.coalesce("sort_order", F.col("position") + 1).cast("int"),
        "aliases": F.coalesce("aliases", empty),
        "options": F.when(F.col("type").isin(*OPTION_TYPES), F.coalesce("options", empty))
        .otherwise(empty),
    })


def duplicate_field_keys(fields: DataFrame) -> DataFrame:
    """P13."""
    return fields.groupBy("template_id", "key").agg(F.count("*").alias("uses")).filter("uses > 1")


def effective_templates(templates: DataFrame) -> DataFrame:
    """The default template of an event, else its oldest; id breaks ties."""
    order = F.struct(
        F.when(F.col("is_default"), 0).otherwise(1), F.col("created_at"), F.col("template_id")
    )
    return templates.groupBy("event_id").agg(F.min_by("template_id", order).alias("template_id"))


def listing_order() -> list[Column]:
    """O1."""
    return [F.col("created_at").desc(), F.col("row_number").asc_nulls_last(), F.col("record_id")]


def export_order() -> list[Column]:
    """O2."""
    return [F.col("row_number").asc_nulls_last(), F.col("created_at"), F.col("record_id")]


def first_success(attempts: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """Per document the first provider in priority order that worked, and the
    redacted text of the failures before it.

    Attempts fold to one row per document and provider first, so the list of a document is
    never longer than the list of providers.
    """
    order = F.create_map(*[x for i, p in enumerate(providers) for x in (F.lit(p), F.lit(i))])
    once = attempts.groupBy("document_id", "provider").agg(
        F.bool_or("ok").alias("ok"), F.min(F.when(~F.col("ok"), F.col("error"))).alias("error")
    )
    ranked = once.withColumn("_rank", F.element_at(order, F.col("provider")))
    best = ranked.groupBy("document_id").agg(
        F.min(F.when(F.col("ok"), F.col("_rank"))).alias("_won"),
        F.sort_array(
            F.collect_list(
                F.when(
                    ~F.col("ok"),
                    F.struct("_rank", "provider",
                             redact_text(F.col("error"), access_token=True).alias("message")),
                )
            )
        ).alias("_failed"),
    )
    names = F.array(*[F.lit(p) for p in providers])
    return best.select(
        "document_id", F.get(names, F.col("_won")).alias("provider"),
        F.filter(
            "_failed", lambda f: F.col("_won").isNull() | (f["_rank"] < F.col("_won"))
        ).alias("failures"),
    )


# Providers in the order they are tried.
PROVIDER_ORDER = ("azure", "google", "textract", "vision", "http", "local", "mock")
