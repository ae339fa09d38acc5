"""Byte-level BPE encoding and decoding with SQL higher-order functions.

The ranks of a public vocabulary are a literal in the plan (a session variable): an array of
small maps, so a look-up by the hash of some bytes is one access. A piece of text is an array
of bytes; a fold merges, again and again, the neighbours whose joined bytes have the lowest
rank, and keeps the ranks of all neighbours in its state, so a merge looks up two pairs only.

Texts are cut before white space that follows other characters; no match of the pattern
crosses such a place, so each segment is matched by itself. The distinct segments of all
documents are counted, and the most frequent ones (``max_words``, none longer than
``max_length``) are encoded once; they are a second literal of bounded size. Segments
outside it are folded where they stand, piece by piece if a piece is not among them either. Nothing but the counts is shuffled.

Decoding looks up the bytes of each id in a literal array and concatenates them.

Defined results: a null or empty text has no ids and decodes to nothing; special tokens are
ordinary text; repeated rows are encoded alike. The time for a piece grows with the square
of its length.
"""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysheet.session import stage

MAX_WORDS = 1 << 18
MAX_LENGTH = 48
RANK_BUCKETS, WORD_BUCKETS = 1 << 15, 1 << 17
NONE = 2147483647
SEGMENTS = r"(?U)(?<=\S)(?=\s)"


class Vocabulary:
    """Ranks and bytes of a vocabulary as literals of the session."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]
        self.spark, self.pattern, self.size = spark, "(?U)" + pattern, len(ranks)
        rows = spark.createDataFrame(ranks, T.StructType([T.StructField("k", T.BinaryType()), T.StructField("v", T.IntegerType())]))
        self.ranks = literal(spark, bucketed(rows, RANK_BUCKETS), "array<map<binary,int>>")
        by_id = F.sort_array(F.collect_list(F.struct("v", F.hex("k").alias("h"))))
        self.hexes = literal(spark, rows.agg(by_id.alias("a")).select(F.col("a.h").alias("a")), "array<string>")

    def close(self) -> None:
        """Drop the variables; tables that were made with them hold their values."""
        for name in (self.ranks, self.hexes):
            drop_literal(self.spark, name)

    def rank(self, x: str) -> str:
        return f"try_element_at(get({self.ranks}, pmod(hash({x}), {RANK_BUCKETS})), {x})"

    def piece_ids(self, w: str) -> str:
        """SQL for the ids of the bytes w, an array<int>."""
        pair = lambda a, b: f"coalesce({self.rank(f'substring({w}, {a} + 1, {b} - {a})')}, {NONE})"
        left = f"CASE WHEN p > 1 THEN array({pair('s.b[p - 2]', 's.b[p + 1]')}) ELSE cast(array() AS array<int>) END"
        right = f"CASE WHEN p < size(s.r) THEN array({pair('s.b[p - 1]', 's.b[p + 2]')}) ELSE cast(array() AS array<int>) END"
        before = "CASE WHEN p > 2 THEN slice(s.r, 1, p - 2) ELSE cast(array() AS array<int>) END"
        merged = f"""named_struct('b', concat(slice(s.b, 1, p), slice(s.b, p + 2, size(s.b))),
            'r', concat({before}, {left}, {right}, slice(s.r, p + 2, size(s.r))))"""
        step = f"""transform(array(array_min(s.r)), m -> CASE WHEN m IS NULL OR m = {NONE} THEN s ELSE
            transform(array(cast(array_position(s.r, m) AS int)), p -> {merged})[0] END)[0]"""
        start = f"""named_struct('b', sequence(0, length({w})),
            'r', transform(sequence(0, length({w}) - 2), i -> {pair('i', '(i + 2)')}))"""
        ids = f"transform(sequence(0, size(e.b) - 2), j -> {self.rank(f'substring({w}, e.b[j] + 1, e.b[j + 1] - e.b[j])')})"
        return f"""CASE WHEN {self.rank(w)} IS NOT NULL THEN array({self.rank(w)}) ELSE
            aggregate(sequence(1, length({w}) - 1), {start}, (s, _) -> {step}, e -> {ids}) END"""

    def text_ids(self, text: str, known: str = "cast(NULL AS string)") -> str:
        """SQL for the ids of a text, written in decimal with one space between them.

        known: SQL for the ids of a piece q where they are known.
        """
        pieces = f'regexp_extract_all({text}, r"{self.pattern}", 0)'
        folded = f"transform(array(cast(q AS binary)), w -> array_join({self.piece_ids('w')}, ' '))[0]"
        return f"array_join(transform({pieces}, q -> coalesce({known}, {folded})), ' ')"

    def decoded(self, ids: Column) -> Column:
        """The bytes of ids written as text_ids does."""
        pieces = F.transform(F.split(ids, " "), lambda i: F.get(F.expr(self.hexes), i.cast("int")))
        return F.unhex(F.when(ids == "", F.lit("")).otherwise(F.array_join(pieces, "")))


def literal(spark: SparkSession, one: DataFrame, kind: str) -> str:
    """A session variable with the only value of a one-row table; its name."""
    name = f"llm_{uuid.uuid4().hex}"
    one.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name}_v {kind}")
    spark.sql(f"SET VAR {name}_v = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return f"{name}_v"


def drop_literal(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """Columns k, v as one array of maps; k is in the map at hash(k) mod buckets."""
    found = rows.groupBy(F.pmod(F.hash("k"), F.lit(buckets)).alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    listed = every.join(found, "bucket", "left").agg(F.collect_list(F.struct("bucket", "m")).alias("a"))
    # maps have no order, so the array is sorted by the bucket alone
    in_order = F.array_sort("a", lambda x, y: x["bucket"] - y["bucket"])
    return listed.select(F.transform(in_order, lambda x: F.coalesce(x["m"], F.create_map().cast(found.schema["m"].dataType))).alias("a"))


def frequent(segments: DataFrame, max_words: int, max_length: int) -> DataFrame:
    """Column k: distinct segments, the most frequent ones up to about max_words."""
    counted = segments.filter(F.length("k") <= max_length).groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    level = F.floor(F.log2("n") * 8)
    kept = stage(counted.select("k", level.alias("level")))
    total, least = 0, None
    for row in sorted(kept.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > max_words:
            break
        least = row["level"]
    return kept.filter(F.col("level") >= least).select("k") if least is not None else kept.filter("false").select("k")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, max_length: int = MAX_LENGTH) -> DataFrame:
    """Columns id_col and ids: the token ids in decimal, with one space between them."""
    spark = docs.sparkSession
    cut = F.split(F.coalesce(docs[text_col], F.lit("")), SEGMENTS, -1)
    words = frequent(docs.select(F.explode(cut).alias("k")), max_words, max_length)
    words = words.select("k", F.expr(vocabulary.text_ids("k")).alias("v"))
    known = literal(spark, bucketed(words, WORD_BUCKETS), "array<map<string,string>>")
    found = lambda x: f"try_element_at(get({known}, pmod(hash({x}), {WORD_BUCKETS})), {x})"
    segments = docs.select(docs[id_col].alias("id"), cut.alias("segments"))
    ids = F.expr(f"array_join(transform(segments, s -> coalesce({found('s')}, {vocabulary.text_ids('s', found('q'))})), ' ')")
    found_ids = segments.select(F.col("id").alias(id_col), ids.alias("ids"))
    # the table holds the value, the session need not
    drop_literal(spark, known)
    return found_ids


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Columns id_col, n_tokens, ids_sha256, decoded_sha256."""
    ids = encode(docs, vocabulary, id_col, text_col, max_words)
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit(""))) + 1)
    return ids.select(
        id_col, n.cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(vocabulary.decoded(F.col("ids")), 256).alias("decoded_sha256"),
    )
