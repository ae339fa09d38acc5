"""Phrase collocations mined shard by shard (SON).

A phrase that occurs min_count times in all must occur min_count / SHARDS times in one of
SHARDS shards at least. So each shard, whatever share of the data it holds, is mined whole at
that lowered support, the phrases frequent in any shard are united, and all of them are
counted exactly over all texts. A shard is what the tasks of one residue read; its phrases
are counted as hashes over buckets of the whole cluster, so no task holds a shard. Phrases of
k words are mined after those of k - 1, among those whose first and last k - 1 words are
frequent in a shard. The union is a bitmap of fixed size: what it admits too much costs time
only, as the final count groups the phrases themselves and keeps those of min_count.

Scores are whole numbers from products in decimals of 38 digits. The best of each language
are ranked in two steps, so no task orders a whole language.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows
count each; a language with words and no phrase of min_count has no rows; no ids are used, and
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysheet.llm.bitmaps import broadcast_bitmap, holds
from tallysheet.llm.substrings import grouped
from tallysheet.llm.words import mix, steps
from tallysheet.session import stage

MIN_COUNT, MAX_WORDS, TOP, COVERED_PCT = 10, 3, 2000, 50
SHARDS = 4
BITS = 1 << 27
#: Words and distinct words that a task gathers before it counts them.
GATHERED, LEXICON = 600_000, 120_000
#: Rows of a batch that a task returns.
ROWS = 10_000
#: Parts in which the best of a language are sought first.
PARTS = 64
#: Largest count a bucket's row can say; no local support goes beyond it.
MOST = 65_535
BASE = np.uint64(0x9E3779B97F4A7C15)

#: A-Z become a-z, ends of pieces a line feed, tabulators blanks.
FOLDED = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
END, NO_WORD = 0, 1
MINED = "part int, keys binary, counts binary"
COUNTED = "lang string, k int, phrase binary, f bigint"


class Lexicon(dict):
    """Numbers of words within a task, and their hashes; 0 is the end of a piece, 1 no word."""

    def __init__(self):
        super().__init__({b"\n": END, b"": NO_WORD})
        self.words = [b"\n", b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        """The words of the pieces of texts; an end stands after each piece."""
        words = b"\n".join(texts).translate(FOLDED).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.r_[found[found != NO_WORD], END]

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lexicon, dict[str, np.ndarray]]]:
    """Word numbers by language, as many as a task counts at once."""
    lexicon, found, size = Lexicon(), {}, 0
    for batch in steps(batches, "text"):
        langs, texts = (c.to_pylist() for c in batch.columns)
        for lang in set(langs):
            numbers = lexicon.numbers([t for t, x in zip(texts, langs, strict=True) if t and x == lang])
            found.setdefault(lang, []).append(numbers)
            size += len(numbers)
        if size >= GATHERED or len(lexicon) >= LEXICON:
            yield lexicon, {x: np.concatenate(parts) for x, parts in found.items()}
            lexicon, found, size = Lexicon(), {}, 0
    yield lexicon, {x: np.concatenate(parts) for x, parts in found.items()}


class Runs:
    """Runs of words of one language: where those of k words start, and their hashes."""

    def __init__(self, numbers: np.ndarray, hashes: np.ndarray, lang: str):
        self.numbers, self.codes = numbers, hashes[numbers]
        self.ends = np.r_[0, np.cumsum(numbers == END)]
        self.hash = mix(self.codes + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
        self.k = 1

    def longer(self) -> None:
        self.k += 1
        self.hash = mix(self.hash[:-1] * BASE + self.codes[self.k - 1 :]) if len(self.hash) else self.hash

    def whole(self) -> np.ndarray:
        """For each start: whether the run lies in one piece."""
        n = len(self.hash)
        return self.ends[self.k : self.k + n] == self.ends[:n]


def _mined(k: int, shorter, n_buckets: int, shards: int) -> Callable:
    """Hashes of runs of k words and their counts, by bucket and shard."""
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for lexicon, texts in gathered(batches):
            hashes, found = lexicon.hashes(), []
            for lang, numbers in texts.items():
                runs = Runs(numbers, hashes, lang)
                for _ in range(k - 2):
                    runs.longer()
                inner = runs.hash
                runs.longer()
                some = runs.whole()
                if shorter:
                    known = holds(shorter.value, inner)
                    some &= known[:-1] & known[1:]
                found.append(runs.hash[some])
            keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            counts = np.minimum(counts, MOST).astype(np.uint16)
            cuts = np.searchsorted(keys >> shift, np.arange(n_buckets + 1, dtype=np.uint64))
            low = (keys >> (shift - np.uint64(32))).astype(np.uint32)
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full * shards + shard, pa.int32()),
                    pa.array([low[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([counts[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                ["part", "keys", "counts"],
            )

    return mined


def _frequent(support: int, n_buckets: int, shards: int) -> Callable:
    """The hashes that a shard has ``support`` times, as far as their bucket and 32 further bits say."""
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in grouped(batches, "part"):
            rows = list(rows)
            keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in rows]).astype(np.int64)
            order = np.argsort(keys)
            keys = keys[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            often = keys[start[np.add.reduceat(counts[order], start) >= support]].astype(np.uint64)
            often = (np.uint64(part // shards) << shift) | (often << (shift - np.uint64(32)))
            yield pa.RecordBatch.from_arrays([pa.array([often.tobytes()], pa.binary())], ["keys"])

    return frequent


def _counted(unions: dict) -> Callable:
    """Words, the words of each language, and the phrases that a union admits, counted."""

    def rows(lang: str, k: int, phrase: Callable, places: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(places), ROWS):
            some = [phrase(x) for x in places[i : i + ROWS].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array([k] * len(some), pa.int32()), pa.array(some, pa.binary()), pa.array(counts[i : i + ROWS], pa.int64())],
                ["lang", "k", "phrase", "f"],
            )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lexicon, texts in gathered(batches):
            hashes, words = lexicon.hashes(), lexicon.words
            for lang, numbers in texts.items():
                times = np.bincount(numbers, minlength=2)
                used = np.flatnonzero(times[2:]) + 2
                if not len(used):
                    continue
                yield from rows(lang, 0, lambda _: b"", used[:1], times[used].sum(keepdims=True))
                yield from rows(lang, 1, words.__getitem__, used, times[used])
                runs, prefix = Runs(numbers, hashes, lang), numbers
                for k, union in unions.items():
                    runs.longer()
                    at = np.flatnonzero(runs.whole() & (prefix[: len(runs.hash)] >= 0) & holds(union.value, runs.hash))
                    # numbers of prefixes and words are exact, so equal keys are equal phrases
                    _, first, same, times = np.unique((prefix[at] << 32) | numbers[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                    prefix = np.full(len(runs.hash), -1, np.int64)
                    prefix[at] = same
                    yield from rows(lang, k, lambda j, k=k, numbers=numbers: b" ".join([words[i] for i in numbers[j : j + k].tolist()]), at[first], times)

    return counted


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS, shards: int = SHARDS, bits: int = BITS,
) -> DataFrame:
    """Columns lang, k, phrase, f: phrases of 1 to max_words words that occur min_count times, and with k = 0 all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].cast("binary").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = 1 << max(6, (4 * partitions - 1).bit_length())
    support, unions = min(-(-min_count // shards), MOST), {}
    for k in range(2, max_words + 1):
        mined = rows.mapInArrow(_mined(k, unions.get(k - 1), n_buckets, shards), MINED)
        often = mined.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_frequent(support, n_buckets, shards), "keys binary")
        unions[k] = broadcast_bitmap(often, bits)
    counts = rows.mapInArrow(_counted(unions), COUNTED).groupBy("lang", "k", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    found = stage(counts.filter((F.col("f") >= min_count) | (F.col("k") == 0)))
    for union in unions.values():
        union.destroy()
    return found


def best_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    top: int = TOP, covered_pct: int = COVERED_PCT, shards: int = SHARDS,
) -> DataFrame:
    """Columns lang_col, rank, phrase, a, l, r, n, score, cut: the ``top`` phrases of each language.

    a, l, r: occurrences of the phrase, its first ``cut`` words and the rest; n: words of the
    language. A phrase inside a longer one with covered_pct % of its occurrences is left out.
    """
    found = phrase_counts(docs, text_col, lang_col, min_count, max_words, shards)
    phrases = found.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def piece(start, size):
        return F.array_join(F.slice("words", start, size), " ")

    cut = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("first"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    parts = found.filter("k > 0").select("lang", "phrase", "f")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    whole = {c: f"cast({c} as decimal(18, 0))" for c in "alr"}
    score = F.expr(f"(1000000 * ({whole['a']} * {whole['a']})) div ({whole['l']} * {whole['r']})").alias("score")
    lowest = F.min(F.struct(score, F.col("cut"), "l", "r")).alias("lowest")
    scored = cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "lowest.*")

    spans = phrases.filter("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    spans = spans.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = spans.groupBy("lang", piece(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered_pct * F.col("a"), F.lit(True)))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = found.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(F.col("lang").alias(lang_col), F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score", "cut")
