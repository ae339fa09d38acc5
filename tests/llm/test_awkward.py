"""Rows that have gone wrong before: clashing names, ids beyond 32 bits, ties, texts without blanks."""

import random
import re
import time

from pyspark.sql import functions as F

from tallysheet.llm import mixing, secrets, sharding, substrings

DOCS = "doc_id bigint, text string, source string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_ids_that_agree_in_32_bits_and_null_ids(spark):
    passage = words(random.Random(1), 60)
    ids = [1, 2**32 + 1, -(2**32) + 1, None, 0, 2**32]
    docs = spark.createDataFrame([(i, passage, "s") for i in ids], DOCS).repartition(2)
    found = {r.doc_id: r.n_removed for r in substrings.remove_repeated_windows(docs).collect()}
    assert found == {-(2**32) + 1: 0, 0: 60, 1: 60, 2**32: 60, 2**32 + 1: 60, None: 0}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "one two three", "s", f"own{i}", -1, "x", "y") for i in range(6)],
                                 DOCS + ", mix string, slot int, shard string, shard_name string")
    placed = sharding.assign_shards(docs, ["a", "b"], ["doc_id"], 101)
    assert placed.columns == ["doc_id", "text", "source", "mix", "slot", "shard", "shard_name"]
    assert {r.shard_name for r in placed.collect()} <= {"a", "b"}
    mixed = mixing.mixed(docs)
    assert mixed.columns.count("mix") == 1 and mixed.select("mix.epoch").count() == 6
    kept = mixing.mixed(docs, mix_col="mix_").select(*docs.columns)
    assert sorted(r.mix for r in kept.collect()) == [f"own{i}" for i in range(6)]


def test_equal_rows_at_the_cut_are_taken_one_by_one(spark):
    rows = [(1, "one two three", "x")] * 10 + [(i + 10, "a b c d e f", "y") for i in range(5)] + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    planned = mixing.plan(docs.select("source", F.lit(0).alias("uid"), mixing.tokens(F.col("text")).alias("n_tokens")), 42).collect()
    aims = {r.source: round(r.weight * 42) for r in planned}
    found = mixing.mixed(docs, budget=42).groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("t"), F.count("*").alias("n")).collect()
    got = {r.source: r.t for r in found}
    assert aims["x"] <= got["x"] < aims["x"] + 3 and aims["y"] <= got["y"] < aims["y"] + 6
    assert {r.source: r.n for r in found}[None] == 3
    assert mixing.mixed(docs.filter("source = 'x'"), budget=21).count() == 7


def test_runs_without_blanks_take_time_in_proportion(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh./") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, long, "s"), (2, long[:500_000] + "7" + long[500_000:], "s"), (3, "é" * 300_000, "s")], DOCS)
    started = time.time()
    found = secrets.candidates(docs, "doc_id", "text", "source").select("id", F.length("value").alias("n")).collect()
    assert time.time() - started < 30
    assert [(r.id, r.n) for r in found] == [(2, 1_000_001)]


def test_cores_as_a_search_from_every_place_finds_them(spark):
    rng = random.Random(5)
    pieces = ["abcdefghijkl", "abc1", "1", "://", "a-b_c.d@e/f+", " ", "é", '"', "token=", "x" * 11, "9" * 12, ",", "AKIA"]
    texts = ["".join(rng.choice(pieces) for _ in range(12)) for _ in range(300)]
    plain = re.compile(r"(?=[A-Za-z_+/.@-]*[0-9])[A-Za-z0-9_+/.@-]{12,}")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", F.regexp_extract_all("t", F.lit(secrets.CORE), 0).alias("c")).collect()
    assert all(r.c == plain.findall(texts[r.i]) for r in got)
