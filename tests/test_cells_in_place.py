"""Cells, spans and their rules are judged where they lie, not exchanged one by one."""

import random

from pyspark.sql import functions as F

from tallysheet.functions.scoring import ACCEPT_SCORE, accepted_score, letters_of, may_be_accepted, own_variants, variants
from tallysheet.functions.text import noisy_term, term
from tallysheet.operators.matching import match_headers, match_spans, with_terms
from tallysheet.plans import tables
from tests.conftest import FIELD_SCHEMA, field


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_letters_never_drop_an_accepted_pair(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc01") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["email", "e", "emailaddress", "9phoneno", "phone"]
    one = spark.createDataFrame([(w,) for w in words], "a string")
    pairs = one.crossJoin(one.withColumnRenamed("a", "b"))
    lost = pairs.filter((accepted_score(F.col("a"), F.col("b")) <= ACCEPT_SCORE) & ~may_be_accepted(
        letters_of(F.col("a")), letters_of(F.col("b"))))
    assert lost.count() == 0
    assert pairs.filter(~may_be_accepted(letters_of(F.col("a")), letters_of(F.col("b")))).count() > 0


def test_own_variants_are_variants(spark):
    rows = spark.createDataFrame([(t,) for t in ("Email 0", "", None, "123", "a1", "b&b", "abc")], "text string")
    read = rows.withColumn("t", term(F.col("text")))
    wrong = read.filter(~own_variants(F.col("t"), noisy_term(F.col("t"))).eqNullSafe(variants(F.array("t"))))
    assert wrong.count() == 0


FIELDS = [field("t", 1, "full_name", "Full Name", "text"), field("t", 2, "email", "Email", "email", required=False)]


def test_spans_match_as_headers_do(spark):
    fields = spark.createDataFrame(FIELDS, FIELD_SCHEMA)
    texts = ["Full Name", "Ful1 Name", "E-mail", "Zebra crossing", "", "name", None, "Full Name"]
    # the last line comes twice, as documents may
    rows = [("d", 1, i, t, "t") for i, t in enumerate(texts)] + [("d", 1, 0, "Full Name", "t"), ("d", 1, 3, "Email", "none")]
    lines = spark.createDataFrame(rows, "document_id string, page int, line_no int, text string, template_id string")
    found = match_spans(with_terms(lines, fields), ["line_no"])
    expected = match_headers(lines, fields, ["line_no"]).select("line_no", "text", F.explode("matches").alias("m")).select(
        "line_no", "text", "m.field_id", "m.sort_order", "m.score")
    assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    # one exchange at most besides that of small tables, and that after unlike spans have been left out
    plan = _plan(found)
    assert plan.count("REPARTITION") + plan.count("RepartitionByExpression") <= 1 and "ObjectHashAggregate" not in plan


def _scored(spark):
    rows = [
        ("d", "t", 1, r, f"f{c}", c, "" if r % 3 == 0 else f"v{r}{c}", "string", 10 * c, r) for r in range(1, 8) for c in (1, 2)
    ] + [("e", "t", 1, 1, "f1", 1, "false", "boolean", None, 1), ("e", "t", 2, 1, "f1", 1, "x", "string", None, None)]
    return spark.createDataFrame(
        rows, "document_id string, template_id string, table_index int, row_index int, field_id string, sort_order int, "
        "normalized_value string, value_kind string, confidence_pct int, page int")


def test_rows_are_kept_by_windows(spark):
    documents = spark.createDataFrame([("d", "t", 3), ("e", "t", None)], "document_id string, template_id string, row_count int")
    kept = tables.keep_filled_rows(_scored(spark).repartition("document_id"), documents, ["table_index", "row_index"])
    rows = {(r.document_id, r.table_index, r.row_index, r.field_id): r for r in kept.collect()}
    assert {k[:3] for k in rows} == {("d", 1, 1), ("d", 1, 2), ("d", 1, 4), ("e", 2, 1)}
    assert rows["d", 1, 4, "f2"].output_row == 3 and rows["d", 1, 4, "f1"].row_confidence_pct == 15
    assert rows["e", 2, 1, "f1"].output_row == 1 and rows["e", 2, 1, "f1"].source_page is None
    assert "Aggregate" not in _plan(kept.drop("row_confidence_pct"))  # nothing is collected


def test_large_documents_are_kept_alike(spark):
    documents = spark.createDataFrame([("d", "t"), ("e", "t")], "document_id string, template_id string")
    place = ["table_index", "row_index"]
    large = documents.select("document_id").limit(1)
    one = tables.keep_filled_rows(_scored(spark), documents, place)
    two = tables.keep_filled_rows(_scored(spark), documents, place, large)
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_cells_carry_every_rule_of_a_field(spark):
    fields = spark.createDataFrame(FIELDS + FIELDS[:1], FIELD_SCHEMA)
    cells = spark.createDataFrame([("t", "t_full_name", "Ada"), ("t", "t_email", "a@b.c"), ("t", "gone", "x")],
                                  "template_id string, field_id string, raw_text string")
    joined = cells.join(tables.field_rules(fields), ["template_id", "field_id"], "left")
    rules = tables.fields_with_rules(fields).select("template_id", "field_id", "rules").distinct()
    carried = tables.with_rules(cells.join(rules, ["template_id", "field_id"], "left"))
    assert sorted(map(str, carried.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
