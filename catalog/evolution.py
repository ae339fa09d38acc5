"""Template evolution, exports, sources and streams (J9, T6, T7, U6, X5, S1, S8-S11, ST1-ST3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.review import _pairs
from tallysheet.functions import text
from tallysheet.operators import evolution, exports
from tallysheet.plans import tables as tables_plan
from tallysheet.session import checkpoint_root
from tallysheet.sources import files, layouts, tables
from tallysheet.streaming import activity, intake, review_state


def _edit(spark, sf):
    """Every fifth field goes, every third id is stale, every fourth key changes, one field is new."""
    stored = b.template_fields(spark, sf)
    k = F.col("field_id").cast("bigint")
    kept = stored.filter(k % 5 != 0).select(
        "template_id", F.col("sort_order").alias("position"),
        F.when(k % 3 == 0, F.concat(F.lit("stale"), "field_id")).otherwise(F.col("field_id")).alias("field_id"),
        F.when(k % 4 == 0, F.concat("key", F.lit("_x"))).otherwise(F.col("key")).alias("key"),
    )
    new = stored.filter(F.col("sort_order") == 8).select(
        "template_id", F.lit(9).alias("position"), F.lit(None).cast("string").alias("field_id"),
        F.lit("extra").alias("key"),
    )
    return kept.unionByName(new)


def _reconciled(spark, sf):
    return evolution.reconcile_fields(b.template_fields(spark, sf), _edit(spark, sf))


def q_j9(spark, sf):
    return _reconciled(spark, sf)


def _mapped_records(spark, sf):
    """Records whose map is keyed by the fields of the template of their order."""
    k = F.col("l_orderkey")
    rows = b._first_lines(spark, sf).select(
        k.cast("string").alias("record_id"), b.template_of(spark, sf, k).alias("template_id"),
        F.col("l_linenumber").alias("sort_order"), F.col("l_returnflag").alias("value"),
    )
    keyed = rows.join(b.template_fields(spark, sf).select("template_id", "sort_order", "key"), ["template_id", "sort_order"])
    return keyed.groupBy("record_id", "template_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("data"))


def q_t6(spark, sf):
    changed = evolution.rename_keys(_mapped_records(spark, sf), evolution.key_changes(_reconciled(spark, sf)))
    return changed.select("record_id", _pairs(F.col("data")).alias("data"))


def q_t7(spark, sf):
    cells = b._first_lines(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        (b.template_of(spark, sf, F.col("l_orderkey")).cast("bigint") * 8 + F.col("l_linenumber") - 1).cast("string").alias("field_id"),
    )
    return evolution.evolve_template(
        b.template_fields(spark, sf), _edit(spark, sf), _mapped_records(spark, sf), cells)[2]


def q_u6(spark, sf):
    stored = b.template_fields(spark, sf)
    kept = stored.filter(F.col("field_id").cast("bigint") % 5 != 0)
    return evolution.removed_fields(stored, kept).select("template_id", "field_id")


def q_x5(spark, sf):
    """Two suggestions a field from the fifth on; the earlier, with one alias, is taken. Applied twice."""
    fields = b.template_fields(spark, sf)
    again = F.explode(F.array(F.lit(20), F.lit(0))).alias("later")
    found = fields.select("*", again).select(
        "template_id", (F.col("sort_order") * 2 + F.col("later")).alias("position"), F.lit("text").alias("type"),
        F.concat("label", F.col("later").cast("string")).alias("label"), "options",
        F.when(F.col("sort_order") > 4, F.concat(F.lit("new_"), "key")).otherwise(F.col("key")).alias("key"),
        F.when(F.col("later") == 0, F.array("label")).otherwise(F.array().cast("array<string>")).alias("aliases"),
    )
    once = evolution.apply_suggestions(fields, found)
    return evolution.apply_suggestions(once, found).select(
        "template_id", "key", "label", "required", "sort_order", F.array_join("aliases", ",").alias("aliases"))


def _export(spark, sf):
    recs = b.records_with_data(spark, sf)
    events = b.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("event_id"),
        F.concat(F.col("n_name"), F.lit(', "'), F.col("n_nationkey").cast("string"), F.lit('"')).alias("title"))
    fields = b.event_fields(spark, sf).withColumn("label", F.concat(F.lit("Field "), "key"))
    return recs, events, b.documents(spark, sf).select("document_id", "file_name"), fields


def q_s9(spark, sf):
    return exports.full_lines(*_export(spark, sf))


def q_s10(spark, sf):
    recs, _, _, fields = _export(spark, sf)
    return exports.sheet_rows(recs, fields).select("event_id", "record_id", F.array_join("values", "|").alias("cells"))


def q_s10_typed(spark, sf):
    kinds = [("f1", "number"), ("f3", "date"), ("f5", "signature"), ("f6", "number")]
    return b.records_with_data(spark, sf).select("record_id", *exports.typed_columns(kinds)).withColumn(
        "f3", b.day_text(F.col("f3")))


def q_s11(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", text.export_name(F.col("text"), "-records").alias("name"))


def q_s8(spark, sf):
    """Pages and conversations as files: a page count is the number of page marks in the content."""
    k = F.col("doc_id")
    name = F.concat(
        F.lit("/in/Scan #"), k.cast("string"),
        F.when(k % 4 == 0, ".PDF").when(k % 4 == 1, ".jpg").when(k % 4 == 2, ".txt").otherwise(".WebP"))
    marks = F.regexp_replace("text", r"(?i)(?<![A-Za-z0-9_])(the|le|la)(?![A-Za-z0-9_])", "/Type /Page ")
    rows = b.table(spark, sf, "documents").select(
        name.alias("path"), (F.col("n_chars") * 100).alias("length"), F.encode(marks, "UTF-8").alias("content"))
    return files.describe_files(rows)


def q_s1(spark, sf):
    """Cells written as the stored table and read back through the declared schema."""
    root = _stream_folder(spark, "tables")
    rows = b.cells(spark, sf).select(
        F.concat_ws("-", "record_id", "field_id").alias("cell_id"), "record_id", "field_id", "normalized_value",
        "confidence", "issues")
    tables.write_tables({"attendance_record_values": rows}, root)
    return tables.read_table(spark, root, "attendance_record_values").select(
        "record_id", "field_id", "normalized_value", "confidence", F.size("issues").alias("issue_count"), "raw_value")


def q_s1_bucketed(spark, sf):
    """The event summary of records and cells that are stored in buckets and meet in place."""
    import uuid

    from tallysheet.operators import reports

    database, root = f"tallysheet_{uuid.uuid4().hex}", _stream_folder(spark, "buckets")
    tables.write_bucketed(
        {"attendance_records": b.records(spark, sf).drop("row_number"), "attendance_record_values": b.cells(spark, sf)}, database, root, 16)
    loaded = tables.load_bucketed(spark, database, root, 16)
    return reports.event_summary(loaded["attendance_records"], loaded["attendance_record_values"])


def _run(query):
    query.awaitTermination()


def _stream_folder(spark, name):
    import uuid
    return f"{checkpoint_root(spark)}/stream-{name}-{uuid.uuid4().hex}"


def q_st1(spark, sf):
    """The batch report of the same marks, counted by a stream over the stored events."""
    folder = _stream_folder(spark, "activity")
    source = b.table(spark, sf, "events").select(
        (F.col("user_id") % 25).cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(1).alias("created"), (F.col("event_type") == "purchase").cast("int").alias("approved"),
        (F.col("event_type") == "error").cast("int").alias("rejected"))
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    counted = activity.stream_daily_activity(stream)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    _run(counted.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start())
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("event_id", "date").agg(
        F.max_by(F.struct("created", "reviewed", "approved", "rejected"), "batch_id").alias("v"))
    return last.select("event_id", b.day_text(F.col("date")).alias("date"), "v.*")


def q_st2(spark, sf):
    """Table responses arrive and go through L1; the even documents come again with other names, every tenth without rows."""
    from catalog.layout import cell_table_responses
    from catalog.layout import documents as layout_documents

    folder = _stream_folder(spark, "intake")
    fields, documents = b.template_fields(spark, sf), layout_documents(spark, sf)
    first, k = cell_table_responses(spark, sf), F.col("document_id").cast("bigint")
    again = first.filter(k % 2 == 0).withColumn(
        "response", F.when(k % 10 == 4, "{}").otherwise(F.regexp_replace("response", "Person ", "Client ")))

    def parse(batch):
        return tables_plan.table_rows(layouts.read_cell_tables(batch), documents, fields)

    for rows in (first, again):
        rows.write.mode("append").json(f"{folder}/in")
        _run(intake.start_intake(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ckpt", parse))
    return intake.current_rows(spark, f"{folder}/out").select(
        "document_id", "output_row", "source_page", "sort_order", "normalized_value", "confidence_pct",
        F.array_join("issues", ",").alias("issues"))


def q_st3(spark, sf):
    from catalog.review import _decisions

    folder = _stream_folder(spark, "review")
    rows = _decisions(spark, sf).withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    _run(review_state.start_review_log(stream, f"{folder}/log", f"{folder}/ckpt"))
    recs = b.records(spark, sf).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    return review_state.reviewed_records(recs, f"{folder}/log").select(
        "record_id", "status", "reviewed_by", b.stamp_text(F.col("reviewed_at")).alias("reviewed_at"))


QUERIES = {
    "j9_reconcile_fields": q_j9, "t6_rename_keys": q_t6, "t7_evolved_cells": q_t7, "u6_removed_fields": q_u6,
    "x5_apply_suggestions": q_x5, "s1_stored_cells": q_s1, "s1_bucketed_summary": q_s1_bucketed, "s8_file_inventory": q_s8, "s9_export_lines": q_s9,
    "s10_sheet_rows": q_s10, "s10_typed_columns": q_s10_typed, "s11_export_names": q_s11,
    "st1_stream_activity": q_st1, "st2_stream_intake": q_st2, "st3_stream_review": q_st3,
}

EDIT = """, inc AS (
    SELECT template_id, sort_order AS position, CASE WHEN CAST(field_id AS BIGINT) % 3 <> 0 THEN field_id END AS own,
      CASE WHEN CAST(field_id AS BIGINT) % 4 = 0 THEN key || '_x' ELSE key END AS key FROM v_template_fields WHERE CAST(field_id AS BIGINT) % 5 <> 0
    UNION ALL SELECT template_id, 9, NULL, 'extra' FROM v_template_fields WHERE sort_order = 8),
  res AS (SELECT inc.*, coalesce(own, k.field_id) AS stored FROM inc LEFT JOIN v_template_fields k
    ON own IS NULL AND k.template_id = inc.template_id AND k.key = inc.key),
  rec AS (SELECT coalesce(f.template_id, res.template_id) AS template_id, f.field_id, f.key AS old_key, res.key AS new_key, position,
      CASE WHEN position IS NULL THEN 'removed' WHEN f.field_id IS NULL THEN 'added' WHEN f.key <> res.key THEN 'renamed' ELSE 'kept' END AS change
    FROM v_template_fields f FULL JOIN res ON res.template_id = f.template_id AND res.stored = f.field_id)
"""
EXPORT_VALUES = "string_agg(coalesce(c.normalized_value, ''), '{sep}' ORDER BY f.n)"
ORACLE = {
    "j9_reconcile_fields": b.sql(EDIT + "SELECT * FROM rec", "v_template_fields"),
    "t6_rename_keys": b.sql(
        EDIT + """, d AS (SELECT l_orderkey AS ord, key, l_returnflag AS value, template_id FROM v_lines
            JOIN v_template_fields ON template_id = CAST(l_orderkey % (SELECT count(*) // 8 FROM part) AS VARCHAR) AND sort_order = l_linenumber),
        x AS (SELECT ord, d.key, value, change, new_key FROM d JOIN rec ON rec.template_id = d.template_id AND old_key = d.key),
        hit AS (SELECT DISTINCT ord FROM x WHERE change IN ('removed', 'renamed')),
        moved AS (SELECT ord, new_key AS key, value FROM x WHERE change = 'renamed'),
        y AS (SELECT * FROM moved UNION ALL SELECT ord, key, value FROM x WHERE change = 'kept' AND (ord, key) NOT IN (SELECT (ord, key) FROM moved))
        SELECT CAST(ord AS VARCHAR) AS record_id, coalesce(string_agg(key || '=' || value, ';' ORDER BY key || '=' || value), '') AS data
        FROM hit LEFT JOIN y USING (ord) GROUP BY ord""", "v_template_fields", "v_lines"),
    "t7_evolved_cells": b.sql(
        EDIT + """SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST((l_orderkey % (SELECT count(*) // 8 FROM part)) * 8 + l_linenumber - 1 AS VARCHAR) AS field_id FROM v_lines
        WHERE CAST((l_orderkey % (SELECT count(*) // 8 FROM part)) * 8 + l_linenumber - 1 AS VARCHAR) NOT IN (SELECT field_id FROM rec WHERE change = 'removed')""",
        "v_template_fields", "v_lines"),
    "u6_removed_fields": b.sql(
        "SELECT template_id, field_id FROM v_template_fields WHERE CAST(field_id AS BIGINT) % 5 = 0", "v_template_fields"),
    "x5_apply_suggestions": b.sql(
        """SELECT template_id, key, label, required, sort_order, '' AS aliases FROM v_template_fields UNION ALL
        SELECT template_id, 'new_' || key, label || '0', false,
          CAST((SELECT count(*) FROM v_template_fields n WHERE n.template_id = f.template_id)
            + row_number() OVER (PARTITION BY template_id ORDER BY sort_order, key) AS INTEGER), label
        FROM v_template_fields f WHERE sort_order > 4
        QUALIFY row_number() OVER (PARTITION BY template_id, key ORDER BY sort_order) = 1""",
        "v_template_fields"),
    "s1_stored_cells": b.sql(
        "SELECT record_id, field_id, normalized_value, confidence, issue_count, CAST(NULL AS VARCHAR) AS raw_value FROM v_cells", "v_cells"),
    "s8_file_inventory": r"""SELECT '/in/Scan #' || doc_id || ext AS path, 'Scan #' || doc_id || ext AS file_name, type AS file_type, n_chars * 100 AS length,
        CAST(CASE WHEN type = 'application/pdf' THEN greatest(1, len(regexp_extract_all(text, '(?i)\b(the|le|la)\b'))) ELSE 1 END AS INTEGER) AS total_pages,
        'Scan-' || doc_id || lower(ext) AS stored_name,
        CASE WHEN type IS NULL THEN 'file_type' WHEN n_chars * 100 > 10485760 THEN 'file_size' END AS reject_reason
      FROM (SELECT *, ['.PDF', '.jpg', '.txt', '.WebP'][doc_id % 4 + 1] AS ext,
        ['application/pdf', 'image/jpeg', NULL, 'image/webp'][doc_id % 4 + 1] AS type FROM documents)""",
    "s9_export_lines": b.sql(
        """, w AS (SELECT r.record_id, string_agg(coalesce(c.normalized_value, ''), ',' ORDER BY n) AS vals
          FROM (SELECT record_id, unnest(range(1, 8)) AS n FROM v_records) r LEFT JOIN v_cells c
            ON c.record_id = r.record_id AND c.field_id = CAST(n AS VARCHAR) GROUP BY r.record_id)
        SELECT r.event_id, row_number() OVER (PARTITION BY r.event_id ORDER BY row_number NULLS LAST, created_at, r.record_id) AS line_no,
          '"' || n_name || ', ""' || r.event_id || repeat('"', 3) || ',' || coalesce(CAST(row_number AS VARCHAR), '') || ','
          || CASE status WHEN 'draft' THEN 'Draft' WHEN 'needs_review' THEN 'Needs review' WHEN 'approved' THEN 'Approved' ELSE 'Rejected' END || ','
          || coalesce(CAST(round(confidence * 100) AS BIGINT) || '%', 'n/a') || ',' || coalesce(file_name, '') || ',' || vals AS line
        FROM v_records r JOIN w USING (record_id) JOIN nation ON CAST(n_nationkey AS VARCHAR) = r.event_id
        LEFT JOIN v_documents d ON d.document_id = r.document_id
        UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 0, 'Event,Row,Status,Confidence,Document,Field f1,Field f2,Field f3,Field f4,Field f5,Field f6,Field f7' FROM nation""",
        "v_records", "v_cells", "v_documents"),
    "s10_sheet_rows": b.sql(
        """SELECT r.event_id, r.record_id, string_agg(coalesce(c.normalized_value, ''), '|' ORDER BY n) AS cells
        FROM (SELECT event_id, record_id, unnest(range(1, 8)) AS n FROM v_records) r LEFT JOIN v_cells c
          ON c.record_id = r.record_id AND c.field_id = CAST(n AS VARCHAR) GROUP BY ALL""", "v_records", "v_cells"),
    "s10_typed_columns": b.sql(
        """SELECT record_id, max(TRY_CAST(normalized_value AS DOUBLE)) FILTER (field_id = '1') AS f1,
          max(normalized_value) FILTER (field_id = '3') AS f3, bool_or(normalized_value = 'true') FILTER (field_id = '5') AS f5,
          max(TRY_CAST(normalized_value AS DOUBLE)) FILTER (field_id = '6') AS f6
        FROM v_records LEFT JOIN v_cells USING (record_id) GROUP BY record_id""", "v_records", "v_cells"),
    "s11_export_names": r"""SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''),
        'records-export') || '-records' AS name FROM documents""",
    "st1_stream_activity": """SELECT CAST(user_id % 25 AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS created,
        count(*) FILTER (event_type IN ('purchase', 'error')) AS reviewed, count(*) FILTER (event_type = 'purchase') AS approved,
        count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY ALL""",
}


def _review_oracle() -> str:
    from catalog.review import ORACLE as review

    return review["t2_apply_decisions"]


def _intake_oracle() -> str:
    from catalog.layout import ORACLE as layout

    batch = layout["l1_table_cells"]
    return f"""SELECT * REPLACE (CASE WHEN CAST(document_id AS BIGINT) % 2 = 0 THEN replace(normalized_value, 'Person ', 'Client ') ELSE normalized_value END AS normalized_value)
      FROM ({batch}) WHERE CAST(document_id AS BIGINT) % 10 <> 4"""


def _summary_oracle() -> str:
    from catalog.reports import ORACLE as reports

    return reports["a2_event_summary"]


ORACLE["s1_bucketed_summary"] = _summary_oracle()
ORACLE["st2_stream_intake"] = _intake_oracle()
ORACLE["st3_stream_review"] = _review_oracle()
