"""Quality, progress and activity reports (A1-A12, T13) for all events at once.

Each report first reduces the large tables with map-side aggregation and only then
joins the small results to dimension tables, so a hot event or document costs one
partial row per task instead of a shuffled group.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import inf, nextafter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.numeric import hundredths, int_div, mean_of, rate
from tallysheet.functions.text import is_populated
from tallysheet.operators.geometry import let
from tallysheet.operators.joins import lookup_join

LOW_CONFIDENCE = 0.75
MANUAL = "manual"
MANUAL_NAME = "Manual rows"
UNATTRIBUTED = "unattributed"
UNATTRIBUTED_EMAIL = "Rows reviewed before reviewer tracking"
UNATTRIBUTED_NAME = "Unattributed"

COUNTS = ("total", "reviewed", "approved", "rejected", "needs_review", "draft")


def _status_aggregates() -> list[Column]:
    known = ("approved", "rejected", "needs_review")
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin("approved", "rejected")).alias("reviewed"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(~F.coalesce(F.col("status").isin(*known), F.lit(False))).alias("draft"),
    ]


def _confidence_aggregates() -> list[Column]:
    return [
        F.sum(hundredths(F.col("confidence"))).alias("_conf_sum"),
        F.count("confidence").alias("_conf_n"),
    ]


def status_counts(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """A1."""
    return records.groupBy(*by).agg(*_status_aggregates())


def remaining_work(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """T13."""
    return status_counts(records, by).select(
        *by, (F.col("draft") + F.col("needs_review")).alias("remaining")
    )


def issue_cells_per_record(cells: DataFrame) -> DataFrame:
    return (
        cells.filter(F.size("issues") > 0).groupBy("record_id")
        .agg(F.count("*").alias("issue_cells"))
    )


def _with_issue_cells(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Both sides are unique on record_id, so this join has no hot key."""
    return records.join(issue_cells_per_record(cells), "record_id", "left")


def event_summary(records: DataFrame, cells: DataFrame) -> DataFrame:
    """A2."""
    facts = _with_issue_cells(
        records.select("record_id", "event_id", "status", "confidence"), cells
    )
    totals = facts.groupBy("event_id").agg(
        *_status_aggregates(),
        *_confidence_aggregates(),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence_records"),
        F.coalesce(F.sum("issue_cells"), F.lit(0)).alias("validation_issue_cells"),
    )
    return totals.select(
        "event_id", *COUNTS,
        rate(F.col("reviewed"), F.col("total")).alias("review_rate"),
        rate(F.col("approved"), F.col("total")).alias("approval_rate"),
        rate(F.col("rejected"), F.col("total")).alias("rejection_rate"),
        mean_of(F.col("_conf_sum"), F.col("_conf_n")).alias("average_confidence_pct"),
        "low_confidence_records", "validation_issue_cells",
    )


def document_report(
    documents: DataFrame, records: DataFrame, cells: DataFrame, bucket: str = MANUAL
) -> DataFrame:
    """A3: every document, plus one bucket per event for rows without a document."""
    facts = _with_issue_cells(
        records.select("record_id", "event_id", "document_id", "status", "confidence", "updated_at"),
        cells,
    )
    per_document = facts.groupBy(
        "event_id", F.coalesce("document_id", F.lit(bucket)).alias("document_id")
    ).agg(
        *_status_aggregates(), *_confidence_aggregates(),
        F.coalesce(F.sum("issue_cells"), F.lit(0)).alias("validation_issue_cells"),
        F.max("updated_at").alias("_record_activity"),
    )
    known = documents.select(
        "event_id", "document_id", "file_name", F.col("updated_at").alias("_document_activity")
    )
    joined = known.join(per_document, ["event_id", "document_id"], "full")
    zero = F.lit(0).cast("bigint")
    counts = [F.coalesce(F.col(c), zero).alias(c) for c in COUNTS]
    return joined.select(
        "event_id", "document_id",
        F.coalesce("file_name", F.when(F.col("document_id") == bucket, MANUAL_NAME)).alias("name"),
        *counts,
        rate(F.coalesce("reviewed", zero), F.coalesce("total", zero)).alias("review_rate"),
        mean_of(F.col("_conf_sum"), F.col("_conf_n")).alias("average_confidence_pct"),
        F.coalesce("validation_issue_cells", zero).alias("validation_issue_cells"),
        F.greatest("_document_activity", "_record_activity").alias("last_activity_at"),
    )


def by_name(reports: DataFrame) -> DataFrame:
    """O3: locale order of names, ties by id."""
    return reports.orderBy("event_id", F.collate("name", "UNICODE"), "document_id")


def reviewer_report(members: DataFrame, users: DataFrame, records: DataFrame) -> DataFrame:
    """A4. Reviewers who left are not listed but stay in the denominator."""
    done = records.filter(F.col("status").isin("approved", "rejected"))
    per_reviewer = done.groupBy("event_id", F.col("reviewed_by").alias("user_id")).agg(
        F.count("*").alias("reviewed"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.max(F.coalesce("reviewed_at", "updated_at")).alias("last_reviewed_at"),
    )
    totals = per_reviewer.groupBy("event_id").agg(F.sum("reviewed").alias("_total"))
    listed = (
        members.select("event_id", "user_id", "role")
        .join(users.select("user_id", "email", "name"), "user_id")
        .join(per_reviewer.filter(F.col("user_id").isNotNull()), ["event_id", "user_id"], "left")
    )
    loose = per_reviewer.filter(F.col("user_id").isNull()).select(
        "event_id", F.lit(UNATTRIBUTED).alias("user_id"), F.lit("reviewer").alias("role"),
        F.lit(UNATTRIBUTED_EMAIL).alias("email"), F.lit(UNATTRIBUTED_NAME).alias("name"),
        "reviewed", "approved", "rejected", "last_reviewed_at",
    )
    rows = lookup_join(listed.unionByName(loose), totals, "event_id", spread=["user_id"])
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "event_id", "user_id", "email", "name", "role",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("reviewed", "approved", "rejected")],
        rate(F.coalesce("reviewed", zero), F.coalesce("_total", zero)).alias("share_of_reviewed"),
        "last_reviewed_at",
    )


def field_quality(fields: DataFrame, records: DataFrame, cells: DataFrame) -> DataFrame:
    """A5 for the fields of each event's effective template.

    `fields` has event_id, field_id, key; populated counts read the record map, the
    other figures read the cells, as two separate sources.
    """
    totals = records.groupBy("event_id").agg(F.count("*").alias("_records"))
    populated = (
        records.select("event_id", F.explode("data").alias("key", "value"))
        .filter(is_populated(F.col("value")))
        .groupBy("event_id", "key")
        .agg(F.count("*").alias("_filled"), F.count_if(F.col("value") == "false").alias("_false"))
    )
    per_field = cells.groupBy("field_id").agg(
        F.count_if(F.size("issues") > 0).alias("issue_cells"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence_cells"),
        *_confidence_aggregates(),
    )
    zero = F.lit(0).cast("bigint")
    unsigned = F.when(F.col("type") == "signature", F.col("_false")).otherwise(zero)
    filled = F.coalesce(F.col("_filled") - unsigned, zero)
    joined = lookup_join(
        fields.select("event_id", "field_id", "key", "type", "required"), totals, "event_id",
        spread=["field_id"],
    )
    return (
        joined.join(populated, ["event_id", "key"], "left")
        .join(per_field, "field_id", "left")
        .select(
            "event_id", "field_id", "key", "type", "required",
            filled.alias("populated_records"),
            F.greatest(zero, F.coalesce("_records", zero) - filled).alias("blank_records"),
            F.coalesce("issue_cells", zero).alias("issue_cells"),
            F.coalesce("low_confidence_cells", zero).alias("low_confidence_cells"),
            mean_of(F.col("_conf_sum"), F.col("_conf_n")).alias("average_confidence_pct"),
        )
    )


def activity_marks(records: DataFrame) -> DataFrame:
    """One row per creation and one per review (U3), ready to count by day."""
    done = F.col("status").isin("approved", "rejected")
    created = F.struct(
        F.to_date("created_at").alias("date"), F.lit(1).alias("created"),
        F.lit(0).alias("approved"), F.lit(0).alias("rejected"),
    )
    reviewed = F.struct(
        F.to_date(F.coalesce("reviewed_at", "updated_at")).alias("date"), F.lit(0).alias("created"),
        (F.col("status") == "approved").cast("int").alias("approved"),
        (F.col("status") == "rejected").cast("int").alias("rejected"),
    )
    marks = F.when(done, F.array(created, reviewed)).otherwise(F.array(created))
    return records.select("event_id", F.explode(marks).alias("m")).select("event_id", "m.*")


def daily_activity(records: DataFrame) -> DataFrame:
    """A6 in one pass over the records."""
    return activity_marks(records).groupBy("event_id", "date").agg(
        F.sum("created").alias("created"),
        F.sum(F.col("approved") + F.col("rejected")).alias("reviewed"),
        F.sum("approved").alias("approved"),
        F.sum("rejected").alias("rejected"),
    )


def recent_activity(records: DataFrame, days: int = 5) -> DataFrame:
    """A6 for the dashboard: the last days with activity of every event."""
    latest = Window.partitionBy("event_id").orderBy(F.col("date").desc())
    return (
        daily_activity(records).withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= days).drop("_rank")
    )


def row_confidence(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """A7 on cells with confidence_pct."""
    return cells.groupBy(*by).agg(
        F.coalesce(
            mean_of(F.sum(F.col("confidence_pct").cast("bigint")), F.count("confidence_pct")),
            F.lit(0).cast("bigint"),
        ).alias("row_confidence_pct")
    )


#: From this position on no row changes a running average that has a value.
SETTLED = 200


def two_decimal_steps() -> list[float]:
    """Smallest double that is written as 0.01, 0.02, .. 1.00 with two decimals."""
    steps = []
    for n in range(1, 101):
        near = (2 * n - 1) / 200
        steps.append(near if Fraction(near) >= Fraction(2 * n - 1, 200) else nextafter(near, 2))
    return steps


def hundredths_as_written(value: Column) -> Column:
    """Hundredths of a double in 0..1 as two decimals show it: by its exact binary value, halves up."""
    steps = F.array(*[F.lit(x) for x in (-inf, *two_decimal_steps(), inf)])

    def nearest(v: Column) -> Column:
        near = F.floor(v * 100 + 0.5).cast("int")
        return (
            F.when(v < F.get(steps, near), near - 1)
            .when(v >= F.get(steps, near + 1), near + 1).otherwise(near)
        )

    return let(value, nearest)


def sequential_average(
    records: DataFrame, group: Sequence[str], position: str, confidence: str = "confidence",
) -> DataFrame:
    """The average kept as a two-decimal running value, row by row, in `position` order.

    `position` counts the rows of a group from 1; confidences lie in 0..1. A row at
    position p moves the value by its distance from it over p, at most 1 / p. That is
    less than half a hundredth beyond SETTLED, so the value is written as before: a group
    of any size is decided by its first SETTLED rows, and if none of these has a
    confidence, by the first later row that has one. Both are partial aggregates; the
    first rows are folded as an array of bounded length, without Python.
    """
    keys = list(group)
    rows = records.select(
        *keys, F.col(position).cast("bigint").alias("_position"),
        F.col(confidence).cast("double").alias("_value"),
    )
    early, given = F.col("_position") <= SETTLED, F.col("_value").isNotNull()
    found = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(early & given, F.struct("_position", "_value")))).alias("_steps"),
        F.min_by("_value", F.when(~early & given, F.col("_position"))).alias("_later"),
    )

    def step(state: Column, row: Column) -> Column:
        place, value = row["_position"], row["_value"]
        mixed = (state / F.lit(100.0) * (place - 1) + value) / place
        return hundredths_as_written(F.when((state < 0) | (place == 1), value).otherwise(mixed))

    folded = F.aggregate("_steps", F.lit(-1), step)
    decided = F.when(F.size("_steps") > 0, folded).otherwise(hundredths_as_written(F.col("_later")))
    return found.select(*keys, decided.cast("bigint").alias("sequential_average_pct"))


def run_rows_summary(rows: DataFrame, cells: DataFrame, preview: int = 3) -> DataFrame:
    """A9, one row per run. Cell values are projected away before anything is counted.

    `rows` has run_id, row_number, confidence; `cells` has run_id, row_number, field_key,
    normalized_value, confidence, issues.
    """
    marks = cells.select(
        "run_id", "row_number",
        is_populated(F.col("normalized_value")).cast("int").alias("_filled"),
        F.size("issues").alias("_issues"),
    )
    per_row = marks.groupBy("run_id", "row_number").agg(
        F.sum("_filled").alias("populated_fields"), F.sum("_issues").alias("issue_count")
    )
    first = Window.partitionBy("run_id").orderBy("row_number")
    shown = (
        rows.select("run_id", "row_number").withColumn("_at", F.row_number().over(first))
        .filter(F.col("_at") <= preview)
        .join(per_row, ["run_id", "row_number"], "left")
        .groupBy("run_id").agg(
            F.sum("populated_fields").alias("preview_populated_fields"),
            F.sum("issue_count").alias("preview_issue_count"),
        )
    )
    totals = rows.groupBy("run_id").agg(F.count("*").alias("row_count"), *_confidence_aggregates())
    return totals.join(shown, "run_id", "left").select(
        "run_id", "row_count",
        mean_of(F.col("_conf_sum"), F.col("_conf_n")).alias("average_confidence_pct"),
        F.coalesce("preview_populated_fields", F.lit(0)).alias("preview_populated_fields"),
        F.coalesce("preview_issue_count", F.lit(0)).alias("preview_issue_count"),
    )


def run_field_summary(cells: DataFrame, by: Sequence[str] = ("run_id", "field_key")) -> DataFrame:
    """A9, one row per run and field."""
    return cells.select(
        *by, is_populated(F.col("normalized_value")).alias("_filled"), "confidence",
        F.size("issues").alias("_issues"),
    ).groupBy(*by).agg(
        F.count_if("_filled").alias("populated_rows"),
        *_confidence_aggregates(),
        F.sum("_issues").alias("issue_count"),
    ).select(
        *by, "populated_rows",
        mean_of(F.col("_conf_sum"), F.col("_conf_n")).alias("average_confidence_pct"),
        "issue_count",
    )


def run_matrix(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """A10."""
    return runs.groupBy(*by).agg(
        F.bool_and("ok").alias("ok"), F.count("*").alias("run_count"),
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"),
    )


def template_profile(fields: DataFrame, by: str = "template_id") -> DataFrame:
    """Fields and required fields of each type in a template; only types in use."""
    return fields.groupBy(by, "type").agg(
        F.count("*").alias("field_count"), F.count_if("required").alias("required_count")
    )


def team_counts(members: DataFrame) -> DataFrame:
    """A12."""
    return members.groupBy("event_id").agg(
        F.count_if(F.col("role") == "owner").alias("owners"),
        F.count_if(F.col("role") == "reviewer").alias("reviewers"),
    )


def record_counts_per_document(documents: DataFrame, records: DataFrame) -> DataFrame:
    """J4."""
    counts = records.filter(F.col("document_id").isNotNull()).groupBy("document_id").agg(
        F.count("*").alias("record_count")
    )
    return documents.join(counts, "document_id", "left").withColumn(
        "record_count", F.coalesce("record_count", F.lit(0).cast("bigint"))
    )
