"""Scoring and spans written out row by row: the same results as their array forms, each computed once."""

import random

from pyspark.sql import functions as F

from tallysheet.functions.scoring import ACCEPT_DISTANCE, ACCEPT_SCORE, accepted_score, pair_score
from tallysheet.operators.geometry import span_sizes, spans, with_lines
from tallysheet.operators.matching import match_headers
from tallysheet.plans.word_tables import scored_header_lines
from tallysheet.plans import word_tables
from tallysheet.sources.layouts import polygon_side

FIELDS = ("template_id string, field_id string, sort_order int, key string, label string, aliases array<string>,"
          " type string, required boolean, options array<string>")


def _fields(spark):
    return spark.createDataFrame(
        [("t", "1", 1, "full_name", "Full Name", [], "text", True, []), ("t", "2", 2, "email", "Email", [], "email", False, [])], FIELDS)


def test_accepted_score_is_pair_score(spark):
    pick = random.Random(7)
    word = lambda: "".join(pick.choice("ab1") for _ in range(pick.randint(1, 24)))
    rows = [(a, b) for a in (word() for _ in range(60)) for b in (a, a[1:] or "a", a + "b", "b" + a[:-1], word(), a[: len(a) // 2] + "1" + a[len(a) // 2:])]
    df = spark.createDataFrame(rows, "a string, b string")
    keep = lambda s: F.when(s <= ACCEPT_SCORE, s)
    got = df.select("a", "b", keep(accepted_score(F.col("a"), F.col("b"))).alias("x"),
                    keep(pair_score(F.col("a"), F.col("b"), ACCEPT_DISTANCE)).alias("y"))
    assert got.filter(~F.col("x").eqNullSafe(F.col("y"))).collect() == []


def test_span_sizes_are_spans(spark):
    pick = random.Random(5)
    lines = []
    for i in range(60):
        x, words = 0.0, []
        for _ in range(pick.randint(1, 9)):
            w = pick.choice([0.0, -3.0, 8.0, 20.0, 41.0])
            words.append((x, w))
            x += w + pick.choice([2.0, 20.0, 30.0, 37.0, 60.0])
        lines.append((i, words))
    df = spark.createDataFrame(lines, "i int, words array<struct<x:double,width:double>>")
    for style in ("grid", "nested"):
        sizes = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda s: span_sizes(F.col("words"), s, style))
        made = F.flatten(F.transform(sizes, lambda n, s: F.transform(F.sequence(F.lit(1), n), lambda k: F.slice("words", s + 1, k))))
        assert df.filter(made != spans(F.col("words"), style)).collect() == []


def test_texts_without_a_match_keep_an_empty_list(spark):
    headers = spark.createDataFrame([("t", "Full Name", 1), ("t", "Zebra", 2), ("u", "Email", 3), ("t", None, 4)], "template_id string, text string, h int")
    got = {r.h: [m.field_id for m in r.matches] for r in match_headers(headers, _fields(spark), ["h"]).collect()}
    assert got == {1: ["1"], 2: [], 3: [], 4: []}


def test_header_lines_are_scored_once(spark):
    words = spark.createDataFrame(
        [("d", 1, i, t, 10.0 + 50 * i, 10.0 + 30 * l, 40.0, 12.0, 90) for l, ts in enumerate((("Full", "Name"), ("Ada", "Byron"))) for i, t in enumerate(ts)],
        "document_id string, page int, word int, text string, x double, y double, width double, height double, confidence_pct int")
    documents = spark.createDataFrame([("d", "t")], "document_id string, template_id string")
    lined = with_lines(word_tables.table_words(words, "nested"), "nested")
    for part in scored_header_lines(lined, documents, _fields(spark), "nested"):
        assert "levenshtein" not in part._jdf.queryExecution().optimizedPlan().toString().lower()


def test_polygons_of_any_length(spark):
    df = spark.createDataFrame([([1.0, 2.0, 5.0, 2.0, 5.0, 4.0, 1.0, 4.0],), ([1.0, 2.0, 3.0],), ([],), (None,)], "p array<double>")
    got = [(r.x, r.y) for r in df.select(polygon_side(F.col("p"), 0).alias("x"), polygon_side(F.col("p"), 1).alias("y")).collect()]
    assert got == [([1, 5, 5, 1], [2, 2, 4, 4]), ([1, 3], [2]), ([], []), (None, None)]
