"""Quality rules: repeated passages inside a document, found with a suffix array.

The words of a document are sorted by all that follows them (prefix doubling over many
documents at once, only among the places that are still tied). Longest common prefixes of
neighbours in that order give for every place the longest passage that starts there and
occurs elsewhere in the same document: the deepest longest-common-prefix interval that
holds the place. Places whose passage merely continues that of the place before are not
maximal and add nothing. The union of the remaining spans is the repeated part.

Rules: a document is rejected if repeats of at least ``min_repeat`` words cover more than
``max_covered`` of its word characters, or if the longest repeat has more than
``max_repeat`` words. Neither rule looks at other documents, so the work is one pass
without a shuffle.

Defined results: a null or empty text has no words, no repeats, and fails the base rules;
a null doc_id is kept as it is; repeated rows are judged each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallysheet.llm.words import as_bytes, spread, steps, texts_of

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Words of the windows of the base rules.
WINDOW = 5

STATS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_maximal_repeats bigint, "
    "longest_repeat bigint, covered_share double"
)


@dataclass(frozen=True)
class Limits:
    """The rules. The base rules are min_words and max_window_percent."""

    min_words: int = 10
    max_window_percent: int = 20
    min_repeat: int = 8
    max_covered: float = 0.30
    max_repeat: int = 100


def suffix_order(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in suffix order within each document, and their ranks by 1, 2, 4, .. words.

    words: a number per word; doc: its document; end: the place behind its document.
    """
    n = len(words)
    key = doc * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    levels, tied, k = [rank], order[np.repeat(sizes > 1, sizes)], 1
    while len(tied):
        after = tied + k
        follows = np.where(after < end[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(rank[tied] * (n + 1) + follows, kind="stable")
        tied, follows = tied[by], follows[by]
        old = rank[tied]
        group = np.r_[True, old[1:] != old[:-1]]
        finer = group | np.r_[True, follows[1:] != follows[:-1]]
        at = np.flatnonzero(group)
        place = old + np.arange(len(tied)) - np.repeat(at, np.diff(np.r_[at, len(tied)]))
        order[place] = tied
        at = np.flatnonzero(finer)
        sizes = np.diff(np.r_[at, len(tied)])
        rank = rank.copy()
        rank[tied] = np.repeat(place[at], sizes)
        levels.append(rank)
        tied = tied[np.repeat(sizes > 1, sizes)]
        k *= 2
    return order, levels


def longest_repeats(words: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """For each place the words of the longest passage from there that recurs in its document.

    Passages of fewer than ``least`` words count as none.
    """
    longest = np.zeros(len(words), np.int64)
    if not len(words):
        return longest
    order, levels = suffix_order(words, doc, end)
    low = min(least.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[low][order[1:]] == levels[low][order[:-1]])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        rank = levels[level]
        same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
        common += same.astype(np.int64) << level
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < least] = 0
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Places inside the passages of at least so many words."""
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    change[at] += 1
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:-1]) > 0


def maximal(longest: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places whose passage is not the rest of the passage one place before."""
    before = np.r_[0, longest[:-1]]
    before[first] = 0
    return (longest > 0) & (before <= longest)


def judge(texts: list[str | None], limits: Limits) -> dict[str, np.ndarray | list]:
    """The columns of STATS for these texts."""
    seen: dict[bytes, int] = {}
    number, n_words, word_chars, symbols, dup_lines = [], [], [], [], []
    for text in texts:
        raw = as_bytes(text)
        words = raw.split()
        number.extend([seen.setdefault(w, len(seen)) for w in words])
        n_words.append(len(words))
        word_chars.append(len(text or "") - len(raw) + len(raw.translate(None, WHITE)))
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = [line for line in raw.split(b"\n") if line.split()]
        dup_lines.append(len(lines) - len(set(lines)))
    words, counts = np.array(number, dtype=np.int64), np.array(n_words, dtype=np.int64)
    doc, starts = spread(counts)
    end = (starts + counts)[doc]
    longest = longest_repeats(words, doc, end, min(WINDOW, limits.min_repeat))
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in seen), np.int64, len(seen))
    sums = lambda x: np.bincount(doc, weights=x, minlength=len(counts)).astype(np.int64)
    repeat_words = sums(covered(longest, WINDOW))
    in_repeat = sums(np.where(covered(longest, limits.min_repeat), chars[words], 0)) if len(words) else counts
    top = np.zeros(len(counts), np.int64)
    np.maximum.at(top, doc, longest)
    share = in_repeat / np.maximum(np.array(word_chars), 1)
    failed = (counts < limits.min_words) | (100 * repeat_words > limits.max_window_percent * counts)
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words, "base_failed": failed,
        "kept": ~failed & (share <= limits.max_covered) & (top <= limits.max_repeat),
        "n_maximal_repeats": sums(maximal(longest, starts[counts > 0])), "longest_repeat": top,
        "covered_share": share,
    }


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: its id, the base counts, the repeats and the verdict."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = judge(texts_of(batch, "text"), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["id", *found])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"id {kind}, {STATS}").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            yield batch.filter(pa.array(judge(texts_of(batch, text_col), limits)["kept"]))

    return docs.mapInArrow(passing, docs.schema)
