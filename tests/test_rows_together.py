"""Cells of a form or a ready row carry what is known of their field and row, so they are not joined one by one."""

import re
from contextlib import contextmanager

from conftest import FIELD_SCHEMA, field

from tallysheet.operators.matching import match_pairs
from tallysheet.plans import tables

FIELDS = [field("t", 1, "name", "Name", "text"), field("t", 2, "email", "Email", "email", required=False),
          field("u", 1, "status", "Status", "select", options=("Open", "Shut")), field("u", 2, "name", "Name", "text")]
PAIRS = "document_id string, item int, key string, value string, confidence_pct int, page int"


@contextmanager
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _exchanges(df):
    found = re.findall(r"hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
    return [re.sub(r"#\d+", "", keys) for keys in found]


def _setup(spark):
    documents = spark.createDataFrame(
        [("a", "t"), ("b", "t"), ("c", "u"), ("d", "u"), ("e", "none")], "document_id string, template_id string")
    return documents, spark.createDataFrame(FIELDS, FIELD_SCHEMA)


def test_forms_are_assigned_by_their_keys(spark):
    documents, fields = _setup(spark)
    pairs = spark.createDataFrame([
        ("a", 0, "Name", "Ada", 80, 1), ("a", 1, "E-mail", "ada at x dot org", 70, None),
        ("b", 0, "Name", "Bob", 81, 3), ("b", 1, "E-mail", "", 71, 2),
        ("c", 0, "Zebra", "?", 60, None), ("d", 3, "Name", "Di", 90, 4), ("d", 5, "Status", "shut", 91, 4),
        ("d", 7, "Name", "Dora", 92, 4), ("e", 0, "Name", "Eve", 99, 1), ("f", 0, "Name", "Fay", 99, 1)], PAIRS)
    found = {(r.document_id, r.sort_order): (r.item, r.score, r.raw_text, r.pair_pct, r.page)
             for r in match_pairs(pairs, documents, fields).collect()}
    assert found == {
        ("a", 1): (0, 0, "Ada", 80, 1), ("a", 2): (1, 0, "ada at x dot org", 70, 1),
        ("b", 1): (0, 0, "Bob", 81, 2), ("b", 2): (1, 0, "", 71, 2),
        ("c", 1): (None, None, None, None, None), ("c", 2): (None, None, None, None, None),
        ("d", 1): (5, 0, "shut", 91, 4), ("d", 2): (3, 0, "Di", 90, 4)}
    with no_broadcast(spark):
        done = tables.pair_rows(pairs, documents, fields)
        assert not [keys for keys in _exchanges(done) if "document_id" in keys or "field_id" in keys]
    rows = {(r.document_id, r.sort_order): (r.normalized_value, r.key, r.output_row, r.source_page) for r in done.collect()}
    assert rows == {
        ("a", 1): ("Ada", "name", 1, 1), ("a", 2): ("ada@x.org", "email", 1, 1), ("b", 1): ("Bob", "name", 1, 2),
        ("b", 2): ("", "email", 1, 2), ("d", 1): ("Shut", "status", 1, 4), ("d", 2): ("Di", "name", 1, 4)}
    assert "form_keys" not in done.columns


def test_ready_rows_are_read_once(spark):
    documents, fields = _setup(spark)
    cell = "array<struct<fieldKey:string,key:string,rawValue:string,normalizedValue:string,confidence:double,issues:array<string>,validationIssues:array<string>>>"
    rows = spark.createDataFrame([
        ("a", "p", 0, 1, 2, None, {"name": "Ada"}, [("email", None, "a at x dot org", None, 0.5, None, None)]),
        ("a", "p", 1, 7, None, 33, {"name": ""}, []), ("d", "p", 0, 1, None, None, {"status": "open"}, None)],
        f"document_id string, provider string, _at int, row_number int, source_page int, row_pct int, data map<string,string>, values {cell}")
    with no_broadcast(spark):
        kept, cells = tables.ready_rows(rows, documents, fields)
        assert not [keys for keys in _exchanges(cells) if "field_id" in keys]
        assert len([keys for keys in _exchanges(kept) if "document_id, _at" in keys]) == 1
    assert sorted((r.document_id, r._at, r.row_number, r.source_page, r.row_confidence_pct) for r in kept.collect()) == [
        ("a", 0, 1, 2, 70), ("a", 1, 7, None, 33), ("d", 0, 1, None, 63)]
    values = {(r.document_id, r._at, r.key): (r.raw_value, r.normalized_value, r.confidence_pct) for r in cells.collect()}
    assert values["a", 0, "email"] == ("a at x dot org", "a@x.org", 50)
    assert values["d", 0, "status"] == ("open", "Open", 92) and values["a", 1, "name"] == ("", "", 34)


def test_rules_meet_the_columns_of_a_table(spark):
    documents, fields = _setup(spark)
    cells = spark.createDataFrame(
        [("a", 0, row, column, row == 0, text, None, 1, None) for row, line in enumerate((("Name", "Email"), ("Ada", "a at x dot org"), ("Bob", "")))
         for column, text in enumerate(line)],
        "document_id string, table_index int, row_index int, column_index int, is_header boolean, text string, provider_pct int, page int, "
        "box struct<page:int,x:double,y:double,width:double,height:double,normalized:boolean>")
    with no_broadcast(spark):
        done = tables.table_rows(cells, documents, fields)
        plan = re.sub(r"#\d+L?", "", done._jdf.queryExecution().executedPlan().toString())
        # rules are looked up below the step that makes cells of a table's columns, once per column
        assert plan.index("explode(transform(_columns") < plan.index("hashpartitioning(template_id, field_id")
    assert {(r.output_row, r.key): (r.normalized_value, r.issues) for r in done.collect()} == {
        (1, "name"): ("Ada", []), (1, "email"): ("a@x.org", []), (2, "name"): ("Bob", []), (2, "email"): ("", [])}
