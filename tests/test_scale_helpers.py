"""Helpers for hot keys and long groups against brute force."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallysheet.operators import geometry, ordered, reports
from tallysheet.operators.joins import hot_keys, lookup_join
from tallysheet.operators.matching import dedupe_keys


def skewed(spark, n=3000):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.34 else f"g{rng.randrange(50)}", i, rng.randrange(100)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, i bigint, v int").repartition(5)


def test_only_counted_hot_keys_are_salted(spark):
    rows, df = skewed(spark)
    lookup = df.select("g").distinct().withColumn("tag", F.concat(F.lit("t"), "g")).filter("g <> 'g3'")
    hot = hot_keys(df, ["g"], 500)
    assert [r.g for r in hot.collect()] == ["hot"] and hot_keys(df, ["g"], 5000) is None
    for how in ("left", "inner"):
        plain = lookup_join(df, lookup, "g", how)
        split = lookup_join(df, lookup, "g", how, spread=["i"], hot=hot)
        assert "_salt" not in split.columns and "_salt" not in plain._jdf.queryExecution().toString()
        assert sorted(map(str, split.select("g", "i", "tag").collect())) == sorted(map(str, plain.select("g", "i", "tag").collect()))


def test_banded_numbering_carry_total_and_previous(spark):
    rows, df = skewed(spark)
    band = F.expr("i div 64")
    order = [F.col("i")]
    value = F.when(F.col("v") < 20, F.col("v"))
    out = ordered.number_rows(df, ["g"], order, band, "n")
    out = ordered.carry_forward(out, ["g"], order, band, value, "c")
    out = ordered.running_total(out, ["g"], order, band, F.col("v"), "t")
    out = ordered.previous_value(out, ["g"], order, band, F.col("v"), "p")
    got = {r.i: (r.n, r.c, r.t, r.p) for r in out.collect()}
    seen = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n, c, t, p = seen.get(g, (0, None, 0, None))
        state = (n + 1, v if v < 20 else c, t + v, v)
        assert got[i] == (state[0], state[1], state[2], p)
        seen[g] = state


def to_fixed(x):
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_sequential_average_is_exact(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 3 else f"d{k % 5}", None if rng.random() < 0.1 else rng.choice([rng.random(), 0.125, 0.375, 1.0, 0.005, 0.0]))
            for k in range(1500)]
    rows += [("bare", None)] * 3 + [("late", None)] * 230 + [("late", 0.285), ("late", 1.0)]
    # pushed from one end to the other as long as a row can move the value
    rows += [("ends", float(k % 2)) for k in range(260)] + [("up", 0.0)] * 198 + [("up", 1.0)] * 60
    places, numbered = {}, []
    for d, c in rows:
        places[d] = places.get(d, 0) + 1
        numbered.append((d, places[d], c))
    want = {}
    for d, place, c in numbered:
        average = want.get(d)
        if c is None:
            want.setdefault(d, None)
            continue
        want[d] = to_fixed(c) if average is None or place == 1 else to_fixed((average * (place - 1) + c) / place)
    df = spark.createDataFrame(numbered, "document_id string, position bigint, confidence double").repartition(6)
    out = reports.sequential_average(df, ["document_id"], "position")
    assert {r.document_id: r.sequential_average_pct for r in out.collect()} == {d: None if v is None else round(v * 100) for d, v in want.items()}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_a_settled_average_stays(spark):
    rng = random.Random(9)
    for place in [reports.SETTLED + 1, reports.SETTLED + 2, 1000, 10**7]:
        for state in range(101):
            for value in [0.0, 1.0, 5e-324, 1 - 2**-53, rng.random()]:
                assert to_fixed((state / 100 * (place - 1) + value) / place) == state / 100


def test_hundredths_are_those_of_the_exact_value(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(300)] + [n / 200 for n in range(201)] + [np.nextafter(n / 200, k) for n in range(1, 200) for k in (0, 1)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", reports.hundredths_as_written(F.col("v")).alias("n")).collect()
    assert all(r.n == round(to_fixed(r.v) * 100) for r in got)


def test_lines_of_a_tall_page(spark):
    rng = random.Random(5)
    ys = sorted(rng.uniform(0, 60_000) for _ in range(900))
    df = spark.createDataFrame([("d", 1, i, y, 10.0) for i, y in enumerate(ys)], "document_id string, page int, word int, y double, height double")
    got = {r.word: r.line_no for r in geometry.with_lines(df, "grid").collect()}
    line = 0
    for i, y in enumerate(ys):
        if i == 0 or y - ys[i - 1] > 6.5:
            line += 1
        assert got[i] == line


def test_levels_of_a_long_page_lie_in_several_tasks(spark):
    words = spark.range(0, 4000).select(
        F.lit("hot").alias("document_id"), F.lit(1).alias("page"), (F.col("id") * 100.0).alias("_level"), F.lit(10.0).alias("height"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        levels = geometry.page_levels(words, geometry.page_tolerance(words, "grid"))
        window = Window.partitionBy(*geometry.PAGE, "_band").orderBy("_level")
        rows = levels.withColumn("at", F.row_number().over(window)).groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in rows) == 4000
    assert max(r["count"] for r in rows) < 2400


def test_unique_keys_step_over_taken_and_literal_ones(spark):
    rows = [("d", 1, "a"), ("d", 2, "a"), ("d", 3, "a_2"), ("d", 4, "a"), ("d", 5, "b"), ("d", 6, "a_2"), ("e", 1, "b")]
    df = spark.createDataFrame(rows, "d string, p int, base string")
    out = dedupe_keys(df, ["d"], "base", F.array(F.lit("b"), F.lit("a_4")), [F.col("p")], F.expr("p div 2"))
    got = {(r.d, r.p): r.unique_key for r in out.collect()}
    assert got == {("d", 1): "a", ("d", 2): "a_3", ("d", 3): "a_2", ("d", 4): "a_5", ("d", 5): "b_2",
                   ("d", 6): "a_2_2", ("e", 1): "b_2"}


def test_medians(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([5.0, -1.0, 0.0],), ([],)], "v array<double>")
    got = df.select(geometry.array_median(F.col("v"), 10.0).alias("a"), geometry.array_upper_median(F.col("v"), 16.0).alias("b")).collect()
    assert [tuple(r) for r in got] == [(2.5, 3.0), (0.0, 5.0), (10.0, 16.0)]
    assert np.median([4, 1, 3, 2]) == 2.5


def test_rows_of_equal_numbers_are_spread_over_ranges(spark):
    from tallysheet.operators.ordered import number_rows_by_range

    rows = spark.range(0, 100_000, 1, 8).select(F.lit(1).alias("g"), F.lit(1).alias("row_number"), F.col("id").alias("k"))
    spread = rows.repartitionByRange(F.col("g"), F.col("row_number"), F.col("k")).groupBy(F.spark_partition_id().alias("b")).count()
    assert spread.count() > 1 and spread.agg(F.max("count")).first()[0] < 60_000
    numbered = number_rows_by_range(rows, ["g"], [F.col("row_number"), F.col("k")], "n")
    assert numbered.filter(F.col("n") != F.col("k") + 1).count() == 0 and numbered.count() == 100_000
