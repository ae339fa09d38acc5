"""The corpus pipeline: five operators of tallysheet.llm one after another.

Each stage takes the documents that the stage before kept, with their columns, and the last
one encodes them. Documents that lose all their words to line dedup go; a document that
mixing takes in several epochs is a row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.llm.bpe import round_trip
from tallysheet.llm.lines import dedup_lines
from tallysheet.llm.mixing import mixed
from tallysheet.llm.ngram_join import one_of_each_group
from tallysheet.llm.quality import keep_quality
from tallysheet.llm.queries import vocabulary
from tallysheet.session import stage


def unused(name: str, columns: list[str]) -> str:
    """A name for a column of a stage that the documents have not."""
    while name in columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in the corpus before go; so do documents without a word left."""
    removed = unused("n_removed", docs.columns)
    found = dedup_lines(docs, n_lines_col=unused("n_lines", docs.columns), n_removed_col=removed)
    left = found.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights."""
    return mixed(docs, mix_col=unused("mix", docs.columns)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and their round trip."""
    known = vocabulary(spark)
    found = round_trip(docs, known)
    known.close()
    return found


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The stages find near copies and encode texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
