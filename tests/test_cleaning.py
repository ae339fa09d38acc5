"""Cell cleaning, text and scoring vectors."""

import pytest
from pyspark.sql import functions as F

from tallysheet.functions import cells, scoring, text
from tallysheet.functions.numeric import blend_confidence, mean_of, rate

VECTORS = [
    ("email", "Ada at Example dot Com", False, [], "ada@example.com", 94, []),
    ("email", "Ada [at] Example dot c0m", False, [], "ada@example.com", 94, []),
    ("email", "ada.example.com", True, [], "ada.example.com", 42, ["bad_email"]),
    ("number", "O1,234", False, [], "1234", 92, []),
    ("number", "-007.50", False, [], "-7.5", 92, []),
    ("number", "-0.0", False, [], "0", 92, []),
    ("number", "12 apples", True, [], "12 apples", 40, ["bad_number"]),
    ("phone", "O8O 12S 34S6", False, [], "0801253456", 90, []),
    ("phone", "0044 123 4567", False, [], "+441234567", 90, []),
    ("phone", "123", False, [], "123", 44, ["bad_phone"]),
    ("date", "17/09/26", False, [], "2026-09-17", 90, []),
    ("date", "9.17.1999", False, [], "1999-09-17", 90, []),
    ("date", "3 October 2024", False, [], "2024-10-03", 90, []),
    ("date", "1O Nov 71", False, [], "1971-11-10", 90, []),
    ("date", "2026-02-30", True, [], "2026-02-30", 40, ["invalid_date"]),
    ("date", "4 Foo 2024", False, [], "4 Foo 2024", 40, ["bad_date"]),
    ("select", "Birds", False, ["Bird", "Rodent"], "Bird", 78, []),
    ("select", "R0dent", False, ["Bird", "Rodent"], "Rodent", 92, []),
    ("select", "Rodemt", False, ["Bird", "Rodent"], "Rodent", 72, []),
    ("select", "-", False, ["Bird"], "-", 46, ["option_unknown"]),
    ("select", "anything", False, [], "anything", 78, []),
    ("select", "Present, Excused", False, ["Present", "Absent", "Excused"], "Present, Excused", 68,
     ["option_multiple"]),
    ("multi_select", "Present, Remote", False, ["Present", "Remote"], "Present, Remote", 90, []),
    ("multi_select", "Remote and Remote; Presemt", False, ["Present", "Remote"], "Remote, Present", 72, []),
    ("multi_select", "Present, Nowhere", True, ["Present", "Remote"], "Present, Nowhere", 46,
     ["options_unknown"]),
    ("signature", "", True, [], "false", 34, ["missing_required"]),
    ("signature", "No", True, [], "false", 50, ["signature_missing"]),
    ("signature", "scribble", False, [], "true", 72, ["signature_unclear"]),
    ("text", " Zoë | “x” ", False, [], 'Zoë "x"', 90, []),
    ("text", " ; ", False, [], "", 68, []),
]


def test_cleaning_vectors(spark):
    rows = [(i, *v[:4]) for i, v in enumerate(VECTORS)]
    df = spark.createDataFrame(rows, "i int, type string, raw_text string, required boolean, options array<string>")
    out = cells.normalize_cells(df.withColumn("option_terms", cells.option_terms(F.col("options"))))
    got = {r.i: (r.normalized_value, r.confidence_pct, list(r.issues)) for r in out.collect()}
    for i, vector in enumerate(VECTORS):
        assert got[i] == vector[4:], vector


def test_cleaning_twice_changes_nothing(spark):
    valid = [v for v in VECTORS if not v[6] and v[0] != "signature" and v[4] != "0"]
    df = spark.createDataFrame(
        [(v[0], v[4], v[2], v[3], v[4]) for v in valid],
        "type string, raw_text string, required boolean, options array<string>, want string",
    ).withColumn("option_terms", cells.option_terms(F.col("options")))
    again = cells.normalize_cells(df)
    assert again.filter(F.col("normalized_value") != F.col("want")).count() == 0


@pytest.mark.parametrize("raw,want", [("Matr1c N0.", "matricno"), ("Ema1l Addre55", "emailaddress"), ("2024", "2024")])
def test_noisy_terms(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.noisy_term(text.term(F.col("t"))).alias("v")).first().v == want


def test_keys_labels_and_lists(spark):
    df = spark.createDataFrame([("Été & co.",), ("***",)], "t string")
    keys = [r.k for r in df.select(text.field_key(F.col("t")).alias("k")).collect()]
    assert keys == ["ete_and_co", "field"]
    one = spark.createDataFrame([("full-name_of  pers., a, ,b",)], "t string").select(
        text.title_label(F.col("t")).alias("l"), text.split_list(F.col("t")).alias("s")).first()
    assert one.l == "Full Name Of Pers., A, ,B"
    assert one.s == ["full-name_of  pers.", "a", "b"]


def test_unicode_is_compatibility_composed(spark):
    df = spark.createDataFrame([("ﬁne ①　​x",), (None,)], "t string")
    assert [r.v for r in df.select(text.clean_text(F.col("t")).alias("v")).collect()] == ["fine 1 x", None]


def test_redaction(spark):
    df = spark.createDataFrame([('x token = "abc" api_key: zz AWS_SECRET_ACCESS_KEY=q Authorization: Bearer a.b, y',)], "t string")
    got = df.select(text.redact_text(F.col("t")).alias("v")).first().v
    assert got == 'x token = "[redacted]" api_key: [redacted] AWS_SECRET_ACCESS_KEY=[redacted] Authorization: Bearer [redacted], y'


def test_field_terms_follow_triggers(spark):
    df = spark.createDataFrame([("matric_no", "Matric No", ["Roll"])], "k string, l string, a array<string>")
    terms = df.select(scoring.field_terms(scoring.configured_terms(F.col("k"), F.col("l"), F.col("a"))).alias("t")).first().t
    assert {"matricno", "regno", "studentid", "roll"} <= set(terms)
    assert "email" not in terms


def test_pair_scores(spark):
    pairs = [("email", "email", 0), ("emailaddress", "email", 9), ("emial", "email", 12), ("ab", "cd", None), ("x", "y", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r.s for r in df.select(scoring.pair_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [p[2] for p in pairs]


def test_whole_number_arithmetic(spark):
    row = spark.range(1).select(
        rate(F.lit(2), F.lit(3)).alias("a"), rate(F.lit(0), F.lit(0)).alias("b"),
        mean_of(F.lit(233), F.lit(3)).alias("c"), mean_of(F.lit(0), F.lit(0)).alias("d"),
        blend_confidence(F.lit(58), F.lit(34), F.lit(1)).alias("e"),
        blend_confidence(F.lit(96), F.lit(94), F.lit(0)).alias("f"),
    ).first()
    assert tuple(row) == (67, 0, 78, None, 41, 95)
