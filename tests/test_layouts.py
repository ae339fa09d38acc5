"""Layout responses to rows, cells and suggestions."""

import json

from conftest import FIELD_SCHEMA, WORD_SCHEMA, as_map, field

from tallysheet.operators import discovery
from tallysheet.operators.storage import quarantine
from tallysheet.plans import tables, word_forms, word_tables
from tallysheet.sources import layouts

FIELDS = [field("t", 1, "name", "Name", "text"), field("t", 2, "email", "Email", "email")]


def cell(row, column, content, kind=None, page=2):
    return {"kind": kind, "rowIndex": row, "columnIndex": column, "content": content, "confidence": 0.9,
            "boundingRegions": [{"pageNumber": page, "polygon": [1, 1, 3.456, 1, 3, 2, 1, 2]}]}


TABLES = {"analyzeResult": {"tables": [
    {"cells": [cell(0, 0, "Full Name", "columnHeader"), cell(0, 1, "Email Address", "columnHeader"),
               cell(0, 2, "Company", "columnHeader"), cell(1, 0, "Ada"), cell(1, 1, "Ada at Example dot com"), cell(1, 2, "Acme")]},
    {"cells": [cell(0, 0, "Bob", page=3), cell(0, 1, "bob@x.org", page=3), cell(1, 0, " ", page=3), cell(2, 0, "Cy", page=3)]},
], "keyValuePairs": [{"key": {"content": "Name:"}, "value": {"content": "Zed"}, "confidence": 0.8}]}}


def setup(spark, payload):
    responses = spark.createDataFrame([("d", json.dumps(payload)), ("bad", "not json")], "document_id string, response string")
    documents = spark.createDataFrame([("d", "t"), ("bad", "t")], "document_id string, template_id string")
    return responses, documents, spark.createDataFrame(FIELDS, FIELD_SCHEMA)


def test_continued_table_reuses_header_and_blank_rows_go(spark):
    responses, documents, fields = setup(spark, TABLES)
    out = tables.table_rows(layouts.read_cell_tables(responses), documents, fields)
    rows = sorted(tables.rows_of(out).collect(), key=lambda r: r.output_row)
    assert [(r.row_number, r.output_row, r.source_page) for r in rows] == [(1, 1, 2), (2, 2, 3), (4, 3, 3)]
    cells = as_map(out.collect(), "output_row", "key")
    assert cells[1, "email"].normalized_value == "ada@example.com"
    assert cells[2, "name"].normalized_value == "Bob"
    assert cells[3, "email"].issues == ["missing_required"]
    assert cells[1, "name"].box.width == 2.46


def test_row_limit_of_a_document(spark):
    responses, documents, fields = setup(spark, TABLES)
    out = tables.table_rows(layouts.read_cell_tables(responses), documents.selectExpr("*", "1 AS row_count"), fields)
    assert {r.output_row for r in out.collect()} == {1}


def test_unmapped_column_is_suggested_once(spark):
    responses, documents, fields = setup(spark, TABLES)
    found = discovery.table_suggestions(layouts.read_cell_tables(responses), documents, fields).collect()
    assert [(r.label, r.key, r.type, r.samples, r.confidence_pct) for r in found] == [("Company", "company", "text", ["Acme"], 72)]


def test_pairs_make_one_row_and_no_pairs_fall_back_to_tables(spark):
    responses, documents, fields = setup(spark, TABLES)
    pairs, cells = layouts.read_listed_pairs(responses), layouts.read_cell_tables(responses)
    out = as_map(tables.form_or_table_rows(pairs, cells, documents, fields).collect(), "key")
    assert out["name"].normalized_value == "Zed" and out["email"].normalized_value == ""
    back = tables.form_or_table_rows(pairs.limit(0), cells, documents, fields)
    assert tables.rows_of(back).count() == 3


def test_bad_response_is_set_aside(spark):
    responses, _, _ = setup(spark, TABLES)
    good, failed = quarantine(layouts.response_errors(responses))
    assert [r.document_id for r in good.collect()] == ["d"]
    row = failed.first()
    assert (row.document_id, row.status, row.layout) == ("bad", "failed", "table")


def words(spark, pages):
    rows = [(d, 2, i, t, float(x), float(y), float(w), 18.0, 90) for d, page in pages.items() for i, (t, x, y, w) in enumerate(page)]
    return spark.createDataFrame(rows, WORD_SCHEMA)


def test_word_table(spark):
    page = [("Full", 10, 10, 34), ("Name", 48, 10, 42), ("Email", 120, 10, 46), ("Address", 170, 10, 68), ("Company", 318, 10, 70),
            ("Ada", 10, 42, 30), ("Okafor", 44, 42, 56), ("Ada", 120, 42, 30), ("at", 154, 42, 16), ("Example", 174, 42, 56),
            ("dot", 234, 42, 24), ("Com", 262, 42, 30), ("Apex", 318, 42, 42), ("Digital", 364, 42, 50), ("Lab", 418, 42, 26)]
    documents = spark.createDataFrame([("d", "t")], "document_id string, template_id string")
    fields = spark.createDataFrame(FIELDS, FIELD_SCHEMA)
    df = words(spark, {"d": page})
    out = as_map(word_tables.word_table_rows(df, documents, fields, "nested").collect(), "key")
    assert out["name"].normalized_value == "Ada Okafor" and out["name"].box.width == 90.0
    assert out["email"].normalized_value == "ada@example.com" and out["email"].source_page == 2
    found = word_tables.word_table_suggestions(df, documents, fields, "nested").collect()
    assert [(r.key, r.samples) for r in found] == [("company", ["Apex Digital Lab"])]


NAME = [("Name", 32, 40, 42), ("Ada", 160, 40, 28), ("Okafor", 196, 40, 54)]


def mail(y):
    return [("Email", 32, y, 42), ("ada@example.com", 160, y, 126)]


CHOICES = [("Attendance", 32, 78, 86), ("X", 60, 112, 12), ("Present", 84, 112, 62), ("Absent", 84, 142, 54)]
FORMS = {
    "lines": [("Name:", 32, 40, 48), *NAME[1:], ("Email", 32, 78, 42), ("Ada", 160, 78, 28), ("at", 192, 78, 16),
              ("Example", 214, 78, 58), ("dot", 278, 78, 26), ("Com", 310, 78, 30), ("Signature", 32, 154, 74), ("Signed", 160, 154, 52)],
    "inline": [("Name:Ada", 32, 40, 72), ("Okafor", 112, 40, 54), ("Email:ada@example.com", 32, 78, 166), ("Signature:Yes", 32, 154, 108)],
    "twice": [*NAME, *mail(78), ("Name", 32, 196, 42), ("Tunde", 160, 196, 48), ("Balogun", 214, 196, 64), ("Email", 32, 234, 42),
              ("tunde@example.com", 160, 234, 142)],
    "wrapped": [*NAME, ("Address", 32, 78, 62), ("14", 160, 78, 18), ("Broad", 184, 78, 48), ("Street", 238, 78, 52),
                ("Floor", 160, 108, 42), ("2", 208, 108, 10), ("Lagos", 224, 108, 46), *mail(146), ("X", 32, 184, 12), ("Signature", 60, 184, 74)],
    "checked": [*NAME, *CHOICES, ("Excused", 84, 172, 62), *mail(216)],
    "several": [*NAME, *CHOICES, ("X", 60, 172, 12), ("Excused", 84, 172, 62), *mail(216)],
    "mark": [*NAME, ("Signature", 32, 82, 74), ("/\\", 164, 84, 36), *mail(126)],
    "strokes": [*NAME, ("Signature", 32, 82, 74), ("/", 164, 106, 8), ("_", 176, 110, 28), ("\\", 214, 106, 8), *mail(160)],
    "blank": [*NAME, ("Signature", 32, 82, 74), ("________", 164, 110, 96), *mail(160)],
}


def test_word_forms(spark):
    signature = ("signature", "Signature", "signature")
    shapes = {
        "lines": [signature], "inline": [signature], "twice": [], "wrapped": [("address", "Address", "text"), signature],
        "checked": [("attendance", "Attendance", "select")], "several": [("attendance", "Attendance", "select")],
        "mark": [signature], "strokes": [signature], "blank": [signature],
    }
    options = ["Present", "Absent", "Excused"]
    fields = [
        field(t, n, k, label, kind, options=options if kind == "select" else ())
        for t, extra in shapes.items()
        for n, (k, label, kind) in enumerate([("name", "Name", "text"), ("email", "Email", "email"), *extra], 1)
    ]
    documents = spark.createDataFrame([(d, d) for d in FORMS], "document_id string, template_id string")
    fields = spark.createDataFrame(fields, FIELD_SCHEMA)
    out = word_forms.grid_form_rows(words(spark, FORMS), documents, fields).collect()
    got = as_map(out, "document_id", "output_row", "key")
    assert all(r.normalized_value == "Ada Okafor" for r in out if r.key == "name" and r.output_row == 1)
    assert all(r.normalized_value == "ada@example.com" for r in out if r.key == "email" and r.output_row == 1)
    assert got["lines", 1, "signature"].normalized_value == "true"
    assert got["inline", 1, "signature"].raw_value == "Yes"
    assert got["inline", 1, "name"].box.x == 32.0 and got["inline", 1, "name"].box.width == 134.0
    assert got["twice", 2, "name"].normalized_value == "Tunde Balogun"
    assert got["wrapped", 1, "address"].normalized_value == "14 Broad Street Floor 2 Lagos"
    assert got["wrapped", 1, "signature"].raw_value == "X"
    assert got["checked", 1, "attendance"].normalized_value == "Present"
    several = got["several", 1, "attendance"]
    assert (several.normalized_value, several.issues) == ("Present, Excused", ["option_multiple"])
    assert got["mark", 1, "signature"].raw_value == "signature mark" and got["mark", 1, "signature"].box.x == 164.0
    assert got["strokes", 1, "signature"].normalized_value == "true" and got["strokes", 1, "signature"].box.width > 50
    blank = got["blank", 1, "signature"]
    assert (blank.normalized_value, blank.issues, blank.box) == ("false", ["missing_required"], None)


def test_large_documents_are_numbered_in_bands_alike(spark, monkeypatch):
    responses, documents, fields = setup(spark, TABLES)
    cells = layouts.read_cell_tables(responses)
    more = cells.selectExpr("'e' AS document_id", *[c for c in cells.columns if c != "document_id"]).unionByName(cells.filter("table_index = 0"))
    documents = documents.unionByName(spark.createDataFrame([("e", "t")], documents.schema))
    for carry in (True, False):
        want = sorted(map(str, tables.table_rows(more, documents, fields, carry).collect()))
        monkeypatch.setattr(tables, "LARGE", 8)  # document e is large then, d is not
        assert [r.document_id for r in tables.large_documents(more).collect()] == ["e"]
        assert sorted(map(str, tables.table_rows(more, documents, fields, carry).collect())) == want
        monkeypatch.undo()
        assert tables.large_documents(more) is None
