"""Words of whole texts and hashes of runs of words, for code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts of one step inside a task hold about so many characters (one longer text is a step of its own).
STEP_CHARS = 400_000
#: Distinct words whose hashes a task keeps before it starts anew.
KEPT_WORDS = 100_000


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def split_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at just these six characters."""
    return as_bytes(text).split()


class WordHashes(dict):
    """64-bit hash of a word, computed once per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of words[i : i + length] for every i; the last length - 1 places are left out."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, power, total, done = np.uint64(0x9E3779B97F4A7C15), words, np.zeros(n, np.uint64), 0
    # hashes of runs of 1, 2, 4, .. words are joined to the length wanted
    size, rest = 1, length
    while rest:
        if rest & 1:
            total = total * _power(base, size) + power[done : done + n]
            done += size
        rest >>= 1
        if rest:
            power = power[:-size] * _power(base, size) + power[size:]
            size *= 2
    return mix(total)


def _power(base: np.uint64, exponent: int) -> np.uint64:
    return np.uint64(pow(int(base), exponent, 1 << 64))


def steps(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts hold about STEP_CHARS characters."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([0 if s is None else s for s in _lengths(column)], dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // STEP_CHARS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if end > start:
                yield batch.slice(start, end - start)


def _lengths(column: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes one after another: the group of each element and the start of each group."""
    starts = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(counts)), counts), starts
