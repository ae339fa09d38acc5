"""The queries of this folder's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallysheet.llm.bpe import Vocabulary, round_trip
from tallysheet.llm.lines import dedup_lines
from tallysheet.llm.mixing import mixed
from tallysheet.llm.ngram_join import jaccard_groups
from tallysheet.llm.phrases import best_phrases
from tallysheet.llm.quality import quality_stats
from tallysheet.llm.ranked_search import ranked_search
from tallysheet.llm.secrets import scan
from tallysheet.llm.sharding import assign_shards
from tallysheet.llm.simhash import simhash_groups
from tallysheet.llm.spotsigs import neighbour_likeness
from tallysheet.llm.substrings import remove_repeated_windows
from tallysheet.llm.toxicity import toxicity


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_stats(documents(spark, sf_dir))


def vocabulary(spark: SparkSession) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vocabulary(spark)
    found = round_trip(documents(spark, sf_dir), known)
    known.close()
    return found


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(documents(spark, sf_dir).select("doc_id"), SHARDS, ["doc_id"])
    return placed.select("doc_id", "slot", "shard", "shard_name")


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_likeness(documents(spark, sf_dir))


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir))


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "source", "mix.*")


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    return simhash_groups(documents(spark, sf_dir))


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return best_phrases(documents(spark, sf_dir)).drop("cut")


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents for each benchmark item."""
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_quality": q_op1,
    "op2_bpe_round_trip": q_op2,
    "op3_forest_secret_scan": q_op3,
    "op4_permutation_sharding": q_op4,
    "op5_fuzzy_line_dedup": q_op5,
    "op6_spotsigs_fingerprints": q_op6,
    "op7_ngram_jaccard_groups": q_op7,
    "op8_super_kmer_dedup": q_op8,
    "op9_temperature_mixing": q_op9,
    "op10_noisy_channel_toxicity": q_op10,
    "op11_gray_simhash_groups": q_op11,
    "op12_son_collocations": q_op12,
    "op13_pipelined_search": q_op13,
}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TERMS = rf"regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op12_son_collocations": rf"""
        with pieces as (
          select row_number() over () as p, lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, {LETTERS}), '[.,;:!?\x0A-\x0D]')) as piece
            from documents)
        ), words as (
          select p, lang, unnest(ws) as w, unnest(range(len(ws))) as i from pieces
        ), runs as (
          select lang, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by p order by i)
        ), counts as materialized (
          select lang, 1 as k, w as phrase, '' as first2, '' as last2, count(*) as f from runs group by all
          union all select lang, 2, w || ' ' || w2, '', '', count(*) from runs where w2 is not null group by all
          union all select lang, 3, w || ' ' || w2 || ' ' || w3, w || ' ' || w2, w2 || ' ' || w3, count(*) from runs where w3 is not null group by all
        ), totals as (
          select lang, sum(f)::bigint as n from counts where k = 1 group by lang
        ), candidates as (
          select lang, k, phrase, first2, last2, f as a, string_split(phrase, ' ') as ws from counts where k > 1 and f >= 10
        ), cuts as (
          select lang, phrase, a, 1 as cut, ws[1] as head, case when k = 2 then ws[2] else last2 end as rest from candidates
          union all select lang, phrase, a, 2, first2, ws[3] from candidates where k = 3
        ), scored as (
          select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
          from cuts c join counts x on x.lang = c.lang and x.phrase = c.head join counts y on y.lang = c.lang and y.phrase = c.rest
        ), lowest as (
          select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
        ), inside as (
          select lang, phrase, max(a) as longer from (
            select lang, first2 as phrase, a from candidates where k = 3 union all select lang, last2, a from candidates where k = 3
          ) group by all
        ), kept as (
          select s.* from lowest s left join inside i on i.lang = s.lang and i.phrase = s.phrase
          where coalesce(100 * i.longer < 50 * s.a, true)
        ), ranked as (
          select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
        )
        select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000""",
    "op13_pipelined_search": rf"""
        with docs as (
          select row_number() over () as u, doc_id, {TERMS} as ts from documents where text is not null
        ), texts as (
          select u, doc_id, ts, len(ts) as n from docs where len(ts) > 0
        ), size as (
          select count(*) as n_docs, sum(n)::bigint as n_terms from texts
        ), postings as (
          select u, doc_id, n, term, count(*) as tf from (select u, doc_id, n, unnest(ts) as term from texts) group by all
        ), wanted as (
          select item_id, term, count(*) as times from (select item_id, unnest({TERMS}) as term from benchmark) group by all
        ), weights as (
          select term, floor(1000 * ln((2.0::double * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as weight
          from postings, size where term in (select term from wanted) group by term
        ), scores as (
          select item_id, u, doc_id,
            sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
          from wanted join weights using (term) join postings using (term), size group by all
        ), ranked as (
          select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0
        )
        select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20""",
}
