"""Reports, review, evolution, storage, exports, files and streams on small fixtures."""

import datetime as dt
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tallysheet.operators import evolution, exports, reports, review, storage
from tallysheet.sources import files, tables
from tallysheet.streaming import activity

RECORD = (
    "record_id string, event_id string, document_id string, row_number int, status string, reviewed_by string, "
    "created_at timestamp, updated_at timestamp, reviewed_at timestamp, confidence double"
)
D27, D28 = dt.datetime(2026, 9, 27, 9), dt.datetime(2026, 9, 28, 9)


def example(spark):
    records = spark.createDataFrame([
        ("r1", "e", "d1", 1, "approved", "u1", D27, D28, D28, 0.95),
        ("r2", "e", "d1", 2, "needs_review", None, D27, D27, None, 0.60),
        ("r3", "e", None, 3, "rejected", None, D27, D28, None, 0.79),
    ], RECORD)
    cells = spark.createDataFrame(
        [("r1", "f1", "a", 0.9, []), ("r1", "f2", "b", 0.9, ["x"]), ("r2", "f1", "c", 0.6, ["x", "y"]), ("r3", "f1", "", 0.8, [])],
        "record_id string, field_id string, normalized_value string, confidence double, issues array<string>")
    return records, cells


def test_report_example(spark):
    records, cells = example(spark)
    s = reports.event_summary(records, cells).first()
    assert (s.total, s.reviewed, s.review_rate, s.approval_rate, s.average_confidence_pct) == (3, 2, 67, 33, 78)
    assert (s.low_confidence_records, s.validation_issue_cells) == (1, 2)
    documents = spark.createDataFrame(
        [("d1", "e", "scan.png", D27), ("d2", "e", "blank.png", D27)],
        "document_id string, event_id string, file_name string, updated_at timestamp")
    got = {r.document_id: r for r in reports.document_report(documents, records, cells).collect()}
    assert (got["manual"].total, got["manual"].review_rate, got["manual"].validation_issue_cells) == (1, 100, 0)
    assert (got["d1"].total, got["d1"].review_rate, got["d1"].validation_issue_cells) == (2, 50, 2)
    assert (got["d2"].total, got["d2"].average_confidence_pct, got["d2"].last_activity_at) == (0, None, D27)
    members = spark.createDataFrame([("e", "u1", "owner")], "event_id string, user_id string, role string")
    users = spark.createDataFrame([("u1", "a@b.cc", "Ada")], "user_id string, email string, name string")
    people = {r.user_id: r.share_of_reviewed for r in reports.reviewer_report(members, users, records).collect()}
    assert people == {"u1": 50, "unattributed": 50}
    days = {str(r.date): (r.created, r.reviewed, r.approved, r.rejected) for r in reports.daily_activity(records).collect()}
    assert days == {"2026-09-27": (3, 0, 0, 0), "2026-09-28": (0, 2, 1, 1)}


def test_counts_add_up(spark):
    records, _ = example(spark)
    row = reports.status_counts(records, ["event_id"]).first()
    assert row.total == row.reviewed + row.needs_review + row.draft


def test_run_summary_hides_values(spark):
    _, cells = example(spark)
    marked = cells.selectExpr("'run' AS run_id", "record_id AS row_number", "field_id AS field_key", "normalized_value", "confidence", "issues")
    rows = marked.select("run_id", "row_number").distinct().withColumn("confidence", F.lit(0.5))
    out = reports.run_rows_summary(rows, marked)
    assert "normalized_value" not in out.columns
    assert (out.first().row_count, out.first().preview_populated_fields, out.first().preview_issue_count) == (3, 3, 3)


def migrate(spark, data, edit):
    existing = spark.createDataFrame([("t", f"f_{k}", k) for k in ("name", "email", "notes")], "template_id string, field_id string, key string")
    incoming = spark.createDataFrame([("t", i, f, k) for i, (f, k) in enumerate(edit)], "template_id string, position int, field_id string, key string")
    records = spark.createDataFrame([("r", "t", data)], "record_id string, template_id string, data map<string,string>")
    done = evolution.reconcile_fields(existing, incoming)
    return {(r.old_key, r.new_key): r.change for r in done.collect()}, evolution.rename_keys(records, evolution.key_changes(done)).collect()


def test_rename_remove_and_add(spark):
    changes, rows = migrate(spark, {"name": "Ada", "email": "a", "notes": "n"},
                            [("f_name", "full_name"), ("f_notes", "notes"), (None, "phone")])
    assert changes == {("name", "full_name"): "renamed", ("notes", "notes"): "kept", ("email", None): "removed", (None, "phone"): "added"}
    assert rows[0].data == {"full_name": "Ada", "notes": "n"}


def test_swap_uses_the_original_map_and_stale_ids_fall_back_to_keys(spark):
    _, rows = migrate(spark, {"name": "N", "email": "E"}, [("f_name", "email"), ("f_email", "name"), ("f_notes", "notes")])
    assert rows[0].data == {"email": "N", "name": "E"}
    changes, rows = migrate(spark, {"name": "N"}, [("old", "name"), ("f_email", "email"), ("f_notes", "notes")])
    assert set(changes.values()) == {"kept"} and rows == []


def test_upsert_and_replace_are_idempotent(spark):
    target = spark.createDataFrame([("k1", "a", "x"), ("k2", "b", "y")], "k string, v string, w string")
    changes = spark.createDataFrame([("k2", None, "z", 1), ("k2", "c", None, 2), ("k3", "d", "q", 1)], "k string, v string, w string, at int")
    once = storage.upsert_by_key(target, changes, ["k"], keep_old_when_null=["w"], latest=[F.col("at")])
    twice = storage.upsert_by_key(once, changes, ["k"], keep_old_when_null=["w"], latest=[F.col("at")])
    want = [("k1", "a", "x"), ("k2", "c", "y"), ("k3", "d", "q")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    records, cells = example(spark)
    recs, cels = records.select("record_id", "document_id"), cells.select("record_id", "field_id")
    new = spark.createDataFrame([("n1", "d1")], "record_id string, document_id string")
    new_cells = spark.createDataFrame([("n1", "f1")], "record_id string, field_id string")
    a, c = storage.replace_by_document(recs, cels, new, new_cells)
    a2, c2 = storage.replace_by_document(a, c, new, new_cells)
    assert sorted(map(str, a.collect())) == sorted(map(str, a2.collect()))
    assert sorted(map(tuple, c2.collect())) == [("n1", "f1"), ("r3", "f1")]


def test_decisions_clear_or_stamp(spark):
    records, _ = example(spark)
    decisions = spark.createDataFrame([("r1", "draft", "u9", D28, "1"), ("r2", "approved", "u9", D28, "2"), ("r2", "rejected", "u8", D27, "3")],
                                      "record_id string, status string, user_id string, decided_at timestamp, decision_id string")
    got = {r.record_id: (r.status, r.reviewed_by, r.reviewed_at) for r in review.apply_decisions(records, decisions).collect()}
    assert got == {"r1": ("draft", None, None), "r2": ("approved", "u9", D28), "r3": ("rejected", None, None)}


def test_export_quoting(spark):
    records = spark.createDataFrame([("r", "e", None, 1, "needs_review", 0.83, D27, {"name": 'Ada "Ace"', "note": "a\nb"})],
                                    "record_id string, event_id string, document_id string, row_number int, status string, confidence double, created_at timestamp, data map<string,string>")
    events = spark.createDataFrame([("e", "Talk, one")], "event_id string, title string")
    documents = spark.createDataFrame([], "document_id string, file_name string")
    fields = spark.createDataFrame([("e", 1, "name", "Name"), ("e", 2, "note", "Note")], "event_id string, sort_order int, key string, label string")
    lines = exports.full_lines(records, events, documents, fields)
    assert [r.line for r in lines.orderBy("line_no").collect()] == [
        "Event,Row,Status,Confidence,Document,Name,Note", '"Talk, one",1,Needs review,83%,,"Ada ""Ace""","a\nb"']
    out = tempfile.mkdtemp()
    exports.write_full(lines, f"{out}/csv")
    assert spark.read.option("lineSep", "\r\n").text(f"{out}/csv").count() == 2
    assert [tuple(r) for r in exports.sheet(records, [("name", "Name"), ("zz", "Other")]).collect()] == [('Ada "Ace"', "")]
    safe = spark.createDataFrame([("=1+1",)], "t string").select(exports.csv_cell(F.col("t"), True).alias("v")).first().v
    assert safe == "'=1+1"


def test_file_inventory_and_reader_plug_in(spark):
    folder = tempfile.mkdtemp()
    for name, body in (("My scan (1).PDF", b"/Type /Page x /Type /Pages /Type/Page"), ("a.txt", b"x"), ("b.png", b"y")):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(body)
    got = {r.file_name: (r.file_type, r.total_pages, r.stored_name, r.reject_reason) for r in files.file_inventory(spark, folder).collect()}
    assert got == {"My scan (1).PDF": ("application/pdf", 2, "My-scan-1.pdf", None), "a.txt": (None, 1, "a.txt", "file_type"),
                   "b.png": ("image/png", 1, "b.png", None)}

    def reader(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"document_id": batch["document_id"], "text": batch["content"].str.upper()})

    pages = spark.createDataFrame([("d", "hi")], "document_id string, content string")
    assert [tuple(r) for r in files.extract_with(pages, reader, "document_id string, text string").collect()] == [("d", "HI")]


def test_stored_tables_round_trip(spark):
    folder = tempfile.mkdtemp()
    rows = spark.createDataFrame([("u", "a@b.cc", "Ada")], "user_id string, email string, name string")
    tables.write_tables({"users": rows}, folder)
    assert tables.read_table(spark, folder, "users").select("user_id", "email", "phone").first() == ("u", "a@b.cc", None)


def test_page_plan_is_clamped(spark):
    rows = spark.createDataFrame([("a", 3, 9, 5), ("b", 5, 2, 9), ("c", None, None, None)], "document_id string, total_pages int, page_start int, page_count int")
    pages = {}
    for r in review.page_plan(rows).collect():
        pages.setdefault(r.document_id, []).append(r.page)
    assert pages == {"a": [3], "b": [2, 3, 4, 5], "c": [1]}


def test_stream_activity_drops_late_rows(spark):
    folder = tempfile.mkdtemp()
    schema = "event_id string, ts timestamp, created int, approved int, rejected int"
    os.mkdir(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    counted = activity.stream_daily_activity(stream, delay="1 day")

    def feed(day):
        spark.createDataFrame([("e", dt.datetime(2026, 1, day), 1, 0, 0)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = (counted.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start())
        query.awaitTermination()

    for day in (1, 9, 1, 20):
        feed(day)
    got = {str(r.date): r.created for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {"2026-01-01": 1, "2026-01-09": 1}
