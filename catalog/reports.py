"""Reports (A1-A12, J4, T13, U1-U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from tallysheet.operators import reports as r
from tallysheet.operators.ordered import number_rows

STATUS_SQL = """count(*) AS total,
  count(*) FILTER (status IN ('approved','rejected')) AS reviewed,
  count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (status = 'needs_review') AS needs_review,
  count(*) FILTER (status NOT IN ('approved','rejected','needs_review')) AS draft"""
CONF_SUM = "CAST(round(confidence * 100) AS BIGINT)"
MEAN = f"""CASE WHEN count(confidence) > 0 THEN
  CAST((2 * sum({CONF_SUM}) + count(confidence)) // (2 * count(confidence)) AS BIGINT) END"""


def _rate(part, total="total"):
    return f"CAST(CASE WHEN {total} > 0 THEN (200 * {part} + {total}) // (2 * {total}) ELSE 0 END AS BIGINT)"


def q_a1(spark, sf):
    return r.status_counts(b.records(spark, sf), ["event_id"])


def q_a2(spark, sf):
    return r.event_summary(b.records(spark, sf), b.cells(spark, sf))


def q_a3(spark, sf):
    report = r.document_report(b.documents(spark, sf), b.records(spark, sf), b.cells(spark, sf))
    return r.by_name(report).withColumn("last_activity_at", b.stamp_text(F.col("last_activity_at")))


def q_a4(spark, sf):
    report = r.reviewer_report(b.members(spark, sf), b.users(spark, sf), b.records(spark, sf))
    return report.withColumn("last_reviewed_at", b.stamp_text(F.col("last_reviewed_at")))


def q_a5(spark, sf):
    return r.field_quality(
        b.event_fields(spark, sf), b.records_with_data(spark, sf), b.event_cells(spark, sf)
    )


def q_a6(spark, sf):
    return r.daily_activity(b.records(spark, sf)).withColumn("date", b.day_text(F.col("date")))


def q_a6_recent(spark, sf):
    return r.recent_activity(b.records(spark, sf)).withColumn("date", b.day_text(F.col("date")))


def _pct_cells(spark, sf):
    return b.cells(spark, sf).withColumn(
        "confidence_pct", F.round(F.col("confidence") * 100).cast("int")
    )


def q_a7(spark, sf):
    return r.row_confidence(_pct_cells(spark, sf), ["record_id"])


def q_a8(spark, sf):
    ordered = b.number_in_document(spark, sf)
    return r.sequential_average(ordered, ["document_id"], "position")


def q_a8_events(spark, sf):
    """Events hold thousands of records each; every fourth one has no confidence in its first 300."""
    rows = number_rows(
        b.records(spark, sf), ["event_id"], [F.col("created_at"), F.col("record_id")], F.year("created_at"), "position")
    bare = (F.col("event_id").cast("int") % 4 == 0) & (F.col("position") <= 300)
    return r.sequential_average(
        rows.withColumn("confidence", F.when(~bare, F.col("confidence"))), ["event_id"], "position")


def q_a9_runs(spark, sf):
    rows = b.records(spark, sf).select(
        F.col("event_id").alias("run_id"), F.col("record_id").alias("row_number"), "confidence"
    )
    cells = b.cells(spark, sf).join(
        b.records(spark, sf).select("record_id", F.col("event_id").alias("run_id")), "record_id"
    ).withColumnRenamed("record_id", "row_number").withColumnRenamed("field_id", "field_key")
    return r.run_rows_summary(rows, cells)


def q_a9_fields(spark, sf):
    return r.run_field_summary(
        b.event_cells(spark, sf).withColumn("run_id", F.col("event_id")), ["run_id", "key"]
    )


def q_a10(spark, sf):
    runs = b.table(spark, sf, "events").select(
        F.col("user_id"), (F.col("event_type") != "error").alias("ok")
    )
    return r.run_matrix(runs, ["user_id"])


def q_a11(spark, sf):
    return r.template_profile(b.template_fields(spark, sf))


def q_a12(spark, sf):
    return r.team_counts(b.members(spark, sf))


def q_j4(spark, sf):
    return r.record_counts_per_document(
        b.documents(spark, sf).select("document_id", "file_name"), b.records(spark, sf)
    )


def q_t13(spark, sf):
    return r.remaining_work(b.records(spark, sf), ["event_id"])


QUERIES = {
    "a1_status_counts": q_a1,
    "a2_event_summary": q_a2,
    "a3_document_report": q_a3,
    "a4_reviewer_report": q_a4,
    "a5_field_quality": q_a5,
    "a6_daily_activity": q_a6,
    "a6_recent_activity": q_a6_recent,
    "a7_row_confidence": q_a7,
    "a8_sequential_average": q_a8, "a8_event_averages": q_a8_events,
    "a9_run_summary": q_a9_runs,
    "a9_run_field_summary": q_a9_fields,
    "a10_run_matrix": q_a10,
    "a11_template_profile": q_a11,
    "a12_team_counts": q_a12,
    "j4_record_counts": q_j4,
    "t13_remaining_work": q_t13,
}

def _running(key: str, confidence: str) -> str:
    """Every row of a group in turn: the value after it as two decimals show it."""
    written = f"len(list_filter({r.two_decimal_steps()}::DOUBLE[], lambda t: t <= CASE WHEN a.s < 0 OR x.p = 1 THEN x.v ELSE (a.s / 100.0::DOUBLE * (x.p - 1) + x.v) / x.p END))"
    return f""", p AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY created_at, record_id) AS position
          FROM v_records WHERE {key} IS NOT NULL),
        g AS (SELECT {key}, list({{'p': position, 'v': {confidence}, 's': -1::BIGINT}} ORDER BY position) FILTER ({confidence} IS NOT NULL) AS rows
          FROM p GROUP BY {key})
        SELECT {key}, list_reduce(rows, lambda a, x: {{'p': x.p, 'v': x.v, 's': {written}::BIGINT}},
          {{'p': 0::BIGINT, 'v': 0::DOUBLE, 's': -1::BIGINT}}).s AS sequential_average_pct FROM g"""


ORACLE = {
    "a8_sequential_average": b.sql(_running("document_id", "confidence"), "v_records"),
    "a8_event_averages": b.sql(
        _running("event_id", "(CASE WHEN CAST(event_id AS INTEGER) % 4 <> 0 OR position > 300 THEN confidence END)"), "v_records"),
    "a1_status_counts": b.sql(f"SELECT event_id, {STATUS_SQL} FROM v_records GROUP BY event_id", "v_records"),
    "a2_event_summary": b.sql(
        f"""SELECT event_id, total, reviewed, approved, rejected, needs_review, draft,
          {_rate('reviewed')} AS review_rate, {_rate('approved')} AS approval_rate,
          {_rate('rejected')} AS rejection_rate, average_confidence_pct, low_confidence_records,
          validation_issue_cells
        FROM (SELECT event_id, {STATUS_SQL}, {MEAN} AS average_confidence_pct,
                count(*) FILTER (confidence < 0.75) AS low_confidence_records
              FROM v_records GROUP BY event_id)
        JOIN (SELECT event_id, count(*) FILTER (issue_count > 0) AS validation_issue_cells
              FROM v_records LEFT JOIN v_cells USING (record_id) GROUP BY event_id) USING (event_id)""",
        "v_records", "v_cells"),
    "a3_document_report": b.sql(
        f"""SELECT event_id, document_id,
          coalesce(file_name, CASE WHEN document_id = 'manual' THEN 'Manual rows' END) AS name,
          coalesce(total, 0) AS total, coalesce(reviewed, 0) AS reviewed, coalesce(approved, 0) AS approved,
          coalesce(rejected, 0) AS rejected, coalesce(needs_review, 0) AS needs_review,
          coalesce(draft, 0) AS draft, {_rate('coalesce(reviewed,0)', 'coalesce(total,0)')} AS review_rate,
          average_confidence_pct, coalesce(validation_issue_cells, 0) AS validation_issue_cells,
          strftime(greatest(d.updated_at, last_update), '%Y-%m-%d %H:%M:%S') AS last_activity_at
        FROM v_documents d FULL JOIN (
          SELECT * FROM (
            SELECT event_id, coalesce(document_id, 'manual') AS document_id, {STATUS_SQL},
              {MEAN} AS average_confidence_pct, max(updated_at) AS last_update
            FROM v_records GROUP BY ALL)
          JOIN (SELECT event_id, coalesce(document_id, 'manual') AS document_id,
              count(*) FILTER (issue_count > 0) AS validation_issue_cells
            FROM v_records LEFT JOIN v_cells USING (record_id) GROUP BY ALL) USING (event_id, document_id)
        ) USING (event_id, document_id)""",
        "v_documents", "v_records", "v_cells"),
    "a4_reviewer_report": b.sql(
        f""", done AS (SELECT * FROM v_records WHERE status IN ('approved','rejected')),
        per AS (SELECT event_id, reviewed_by, count(*) AS reviewed,
            count(*) FILTER (status = 'approved') AS approved,
            count(*) FILTER (status = 'rejected') AS rejected,
            max(coalesce(reviewed_at, updated_at)) AS last_at FROM done GROUP BY ALL),
        tot AS (SELECT event_id, count(*) AS all_done FROM done GROUP BY ALL),
        rows AS (
          SELECT m.event_id, m.user_id, u.email, u.name, m.role, per.reviewed, per.approved, per.rejected, per.last_at
          FROM v_members m JOIN v_users u ON u.user_id = m.user_id
          LEFT JOIN per ON per.event_id = m.event_id AND per.reviewed_by = m.user_id
          UNION ALL
          SELECT event_id, 'unattributed', 'Rows reviewed before reviewer tracking', 'Unattributed',
            'reviewer', reviewed, approved, rejected, last_at FROM per WHERE reviewed_by IS NULL)
        SELECT event_id, user_id, email, name, role, coalesce(reviewed, 0) AS reviewed,
          coalesce(approved, 0) AS approved, coalesce(rejected, 0) AS rejected,
          {_rate('coalesce(reviewed,0)', 'coalesce(all_done,0)')} AS share_of_reviewed,
          strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_reviewed_at
        FROM rows LEFT JOIN tot USING (event_id)""".lstrip(),
        "v_members", "v_users", "v_records"),
    "a5_field_quality": b.sql(
        f""", c AS (SELECT v_cells.*, event_id FROM v_cells JOIN v_records USING (record_id))
        SELECT f.event_id, f.field_id, f.key, f.type, f.required,
          coalesce(populated, 0) AS populated_records,
          greatest(0, records - coalesce(populated, 0)) AS blank_records,
          coalesce(issue_cells, 0) AS issue_cells, coalesce(low, 0) AS low_confidence_cells, average_confidence_pct
        FROM v_event_fields f
        JOIN (SELECT event_id, count(*) AS records FROM v_records GROUP BY ALL) USING (event_id)
        LEFT JOIN (
          SELECT event_id, event_id || '_' || field_id AS field_id,
            count(*) FILTER (normalized_value <> '' AND NOT (field_id = '5' AND normalized_value = 'false')) AS populated,
            count(*) FILTER (issue_count > 0) AS issue_cells,
            count(*) FILTER (confidence < 0.75) AS low, {MEAN} AS average_confidence_pct
          FROM c GROUP BY ALL) q ON q.field_id = f.field_id""",
        "v_event_fields", "v_records", "v_cells"),
    "a6_daily_activity": b.sql(
        """, d AS (
          SELECT event_id, created_at::DATE AS day, 1 AS c, 0 AS a, 0 AS j FROM v_records
          UNION ALL
          SELECT event_id, coalesce(reviewed_at, updated_at)::DATE, 0, CAST(status = 'approved' AS INTEGER),
            CAST(status = 'rejected' AS INTEGER) FROM v_records WHERE status IN ('approved','rejected'))
        SELECT event_id, strftime(day, '%Y-%m-%d') AS date, CAST(sum(c) AS BIGINT) AS created,
          CAST(sum(a + j) AS BIGINT) AS reviewed, CAST(sum(a) AS BIGINT) AS approved,
          CAST(sum(j) AS BIGINT) AS rejected FROM d GROUP BY event_id, day""", "v_records"),
    "a7_row_confidence": b.sql(
        f"SELECT record_id, {MEAN} AS row_confidence_pct FROM v_cells GROUP BY record_id", "v_cells"),
    "a9_run_summary": b.sql(
        f""", first3 AS (SELECT event_id, record_id FROM v_records
             QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY record_id) <= 3)
        SELECT event_id AS run_id, row_count, average_confidence_pct,
          coalesce(filled, 0) AS preview_populated_fields, coalesce(issues, 0) AS preview_issue_count
        FROM (SELECT event_id, count(*) AS row_count, {MEAN} AS average_confidence_pct FROM v_records GROUP BY ALL)
        LEFT JOIN (SELECT event_id, count(*) FILTER (normalized_value <> '') AS filled,
             CAST(sum(issue_count) AS BIGINT) AS issues
          FROM first3 JOIN v_cells USING (record_id) GROUP BY ALL) USING (event_id)""",
        "v_records", "v_cells"),
    "a9_run_field_summary": b.sql(
        f"""SELECT event_id AS run_id, 'f' || field_id AS key, count(*) FILTER (normalized_value <> '') AS populated_rows,
          {MEAN.replace('confidence', 'v_cells.confidence')} AS average_confidence_pct, CAST(sum(issue_count) AS BIGINT) AS issue_count
        FROM v_cells JOIN v_records USING (record_id) GROUP BY ALL""", "v_records", "v_cells"),
    "a10_run_matrix": """SELECT user_id, bool_and(event_type <> 'error') AS ok, count(*) AS run_count,
        count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed
        FROM events GROUP BY user_id""",
    "a11_template_profile": b.sql(
        """SELECT template_id, type, count(*) AS field_count, count(*) FILTER (required) AS required_count
        FROM v_template_fields GROUP BY ALL""", "v_template_fields"),
    "a12_team_counts": b.sql(
        """SELECT event_id, count(*) FILTER (role = 'owner') AS owners,
        count(*) FILTER (role = 'reviewer') AS reviewers FROM v_members GROUP BY event_id""", "v_members"),
    "j4_record_counts": b.sql(
        """SELECT d.document_id, file_name, count(record_id) AS record_count
        FROM v_documents d LEFT JOIN v_records r ON r.document_id = d.document_id GROUP BY ALL""",
        "v_documents", "v_records"),
    "t13_remaining_work": b.sql(
        """SELECT event_id, count(*) FILTER (status IN ('draft','needs_review')) AS remaining
        FROM v_records GROUP BY event_id""", "v_records"),
}
ORACLE["a6_recent_activity"] = (
    f"SELECT * FROM ({ORACLE['a6_daily_activity']}) "
    "QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY date DESC) <= 5"
)
