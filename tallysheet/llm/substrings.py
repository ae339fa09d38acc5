"""Substring dedup: windows of words that also start in an earlier document are removed.

Super-k-mer partitioning. The minimiser of a window is the smallest hash among its runs of
``MINIMISER_WORDS`` words. Neighbouring windows mostly share it; such a run of windows
travels as one packed string (four bytes a word, a hash of the word) to the bucket of the
minimiser, so equal windows meet in one bucket however the documents are spread. There the
windows are sorted by their content and the smallest doc_id of each is found; a hash only
brings equal windows together, the packed words decide.

1. A first pass sends just the minimisers, once per step of a task, and finds those that
   occur in more than one document. They become a bitmap of fixed size (``bits``). Windows
   whose minimiser is not in it are unique; documents without others are finished.
2. The second pass packs the other windows. A window that has a smaller doc_id within the
   same step is decided at once, so a passage that stands in a third of all documents
   reaches its bucket at most once per step.
3. Buckets return spans of windows to remove; they meet the texts of the documents
   concerned, which are the only texts that are shuffled.

Defined results: a null or empty text has no words; a text of fewer words than a window
loses none; windows of documents with equal or null doc_ids do not remove each other;
each of several equal rows gets its own result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.bitmaps import broadcast_bitmap, holds
from tallysheet.llm.words import WordHashes, as_bytes, run_hashes, split_words, spread, steps, texts_of

WINDOW = 50
MINIMISER_WORDS = 12
#: Bits of the bitmap of repeated minimisers: 16 MB.
BITS = 1 << 27

#: Rows that travel: finished documents, texts with windows that may recur, spans to remove
#: (pairs of places) and packed runs of windows.
DONE, TEXT, SPANS, PACKED = 0, 1, 2, 3


def minimisers(hashes: np.ndarray, window: int, length: int) -> np.ndarray:
    """Smallest hash of a run of ``length`` words within each window (also those that cross documents)."""
    low, wide = run_hashes(hashes, length), window - length + 1
    size = 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = wide - size
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def whole_windows(counts: np.ndarray, window: int) -> np.ndarray:
    """Places where a window starts that lies in one document."""
    doc, starts = spread(counts)
    n = max(0, len(doc) - window + 1)
    return np.arange(n) + window <= (starts + counts)[doc[:n]]


def first_owner(words: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For windows words[at : at + window]: the smallest owner of an equal window.

    words: uint32. Windows are brought together by a hash and compared word by word.
    """
    key = run_hashes(words.astype(np.uint64), window)[at]
    order = np.lexsort((owner, key))
    while True:
        k = key[order]
        new = np.r_[True, k[1:] != k[:-1]][: len(k)]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(k) else order
        differs = np.zeros(len(order), bool)
        pairs = np.flatnonzero(~new)
        for j in range(window):
            differs[pairs] |= words[at[order[pairs]] + j] != words[at[head[pairs]] + j]
        if not differs.any():
            break
        # equal hashes of different words: these windows are grouped anew under another key
        key = key.copy()
        key[order[differs]] = np.array([hash(words[a : a + window].tobytes()) & (2**64 - 1) for a in at[order[differs]]], np.uint64)
        order = np.lexsort((owner, key))
    first = np.empty(len(order), owner.dtype)
    first[order] = owner[head]
    return first


def runs(flags: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags; a change of one of ``same`` ends a run."""
    change = np.zeros(len(flags), bool)
    for x in same:
        change[1:] |= x[1:] != x[:-1]
    begins = flags & (np.r_[True, ~flags[:-1]][: len(flags)] | change)
    ends = flags & (np.r_[~flags[1:], True][: len(flags)] | np.r_[change[1:], True][: len(flags)])
    return np.flatnonzero(begins), np.flatnonzero(ends)


def _key_blobs(n_buckets: int, window: int, length: int) -> Callable:
    """Per step and bucket: minimisers, and which of them stand in several documents of the step."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in steps(batches, "text"):
            words = [split_words(t) for t in texts_of(batch, "text")]
            counts = np.array([len(w) for w in words], dtype=np.int64)
            hashes = cache.of([w for ws in words for w in ws])
            if len(hashes) < window:
                continue
            whole, low = whole_windows(counts, window), minimisers(hashes, window, length)
            doc = spread(counts)[0][: len(low)]
            begins, _ = runs(whole, doc, low)
            key, of = low[begins], doc[begins]
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            many = np.zeros(len(key), bool)
            many[np.flatnonzero(new)[(np.cumsum(new) - 1)[~new & np.r_[False, of[1:] != of[:-1]][: len(key)]]]] = True
            key, many = key[new], many[new]
            bucket = (key >> np.uint64(64 - (n_buckets.bit_length() - 1))).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([key[cuts[i]:cuts[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([many[cuts[i]:cuts[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                ["bucket", "keys", "many"],
            )

    return blobs


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of one key after another; the batches are sorted by it."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[by] != key and rows:
                yield key, rows
                rows = []
            key = row[by]
            rows.append(row)
    if rows:
        yield key, rows


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(batches, "bucket"):
        key = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        many = np.concatenate([np.frombuffer(r["many"], bool) for r in rows])
        key, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        count = count + np.bincount(inverse, weights=many, minlength=len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[count > 1].tobytes()], pa.binary())], ["keys"])


def _rows(kind: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; the columns not given are null."""
    types = PACKED_TYPES if kind in (SPANS, PACKED) else TEXT_TYPES
    n = len(next(iter(columns.values())))
    values = {"kind": np.full(n, kind)} | columns
    return pa.RecordBatch.from_arrays([pa.array(values.get(c, [None] * n), t) for c, t in types.items()], list(types))


PACKED_TYPES = {"kind": pa.int32(), "uid": pa.int64(), "bucket": pa.int32(), "payload": pa.binary()}
TEXT_TYPES = {
    "kind": pa.int32(), "uid": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(),
    "n_removed": pa.int64(), "kept": pa.string(), "packed": pa.binary(),
}
PACKED_SCHEMA = "kind int, uid bigint, bucket int, payload binary"
TEXT_SCHEMA = "kind int, uid bigint, doc_id bigint, n_words bigint, n_removed bigint, kept string, packed binary"


class Step:
    """The texts of one step: their words, and the windows whose minimiser is in the bitmap."""

    def __init__(self, batch: pa.RecordBatch, cache: WordHashes, bitmap: np.ndarray, window: int, length: int):
        self.texts, self.ids = texts_of(batch, "text"), texts_of(batch, "doc_id")
        words = [split_words(t) for t in self.texts]
        self.counts = np.array([len(w) for w in words], dtype=np.int64)
        self.codes = cache.of([w for ws in words for w in ws])
        doc, self.starts = spread(self.counts)
        known = np.array([i is not None for i in self.ids], dtype=bool)
        self.owner = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        self.low = minimisers(self.codes, window, length) if len(self.codes) >= window else np.zeros(0, np.uint64)
        self.of = doc[: len(self.low)]
        self.flags = whole_windows(self.counts, window)[: len(self.low)] & holds(bitmap, self.low) & known[self.of]

    def uids(self) -> np.ndarray:
        """The same for equal rows, whichever task reads them; no text ends in the mark of a null id."""
        found = [
            xxhash.xxh3_64_intdigest(as_bytes(t) + (b"\xff" if i is None else b""), seed=(i or 0) & 0xFFFFFFFFFFFFFFFF)
            for t, i in zip(self.texts, self.ids, strict=True)
        ]
        return np.array(found, dtype=np.uint64).astype(np.int64)


def _packed(n_buckets: int, window: int, length: int, repeated) -> Callable:
    """Packed runs of windows by bucket, and the spans that are decided within a step."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shift = WordHashes(), np.uint64(64 - (n_buckets.bit_length() - 1))
        codec = pa.Codec("zstd", 1)
        for batch in steps(batches, "text"):
            step = Step(batch, cache, repeated.value, window, length)
            at = np.flatnonzero(step.flags)
            if not len(at):
                continue
            words, uids, owner = step.codes.astype(np.uint32), step.uids(), step.owner[step.of[at]]
            later = owner > first_owner(words, at, owner, window)
            decided = np.zeros(len(step.flags), bool)
            decided[at[later]] = True
            first, last = runs(decided, step.of)
            of = step.of[first]
            yield _span_rows(uids[of], first - step.starts[of], last - step.starts[of] + window, n_buckets)
            first, last = runs(step.flags & ~decided, step.of, step.low)
            bucket = (step.low[first] >> shift).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, size, bucket = first[order], (last - first + window)[order], bucket[order]
            of = step.of[first]
            head = np.stack([uids[of], step.owner[of], first - step.starts[of], size])
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            full, payload = np.flatnonzero(np.diff(cuts)), []
            for i in full:
                part = slice(cuts[i], cuts[i + 1])
                run, offset = spread(size[part])
                body = words[first[part][run] + np.arange(len(run)) - offset[run]]
                raw = np.int64(len(offset)).tobytes() + head[:, part].tobytes() + body.tobytes()
                payload.append(pack(raw, codec))
            yield _rows(PACKED, bucket=full, payload=payload)

    return packed


def _span_rows(uid: np.ndarray, start: np.ndarray, end: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A row per uid: its spans as pairs of places."""
    order = np.argsort(uid, kind="stable")
    uid, spans = uid[order], np.stack([start, end], axis=1)[order].astype(np.int64)
    at = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]][: len(uid)])
    payload = [x.tobytes() for x in np.split(spans, at[1:])] if len(at) else []
    return _rows(SPANS, uid=uid[at], bucket=uid[at] % n_buckets, payload=payload)


def _bucket_spans(window: int, n_buckets: int) -> Callable:
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for _, rows in grouped(batches, "bucket"):
            heads, bodies = [], []
            for row in rows:
                if row["kind"] == SPANS:
                    yield _rows(SPANS, uid=[row["uid"]], payload=[row["payload"]])
                    continue
                raw = unpack(row["payload"], codec)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                heads.append(np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n))
                bodies.append(np.frombuffer(raw, np.uint32, -1, 8 + 32 * n))
            if not heads:
                continue
            uid, owner, start, size = np.concatenate(heads, axis=1)
            words = np.concatenate(bodies)
            run, offset = spread(size)
            at = np.flatnonzero(whole_windows(size, window))
            later = owner[run[at]] > first_owner(words, at, owner[run[at]], window)
            flags = np.zeros(len(words), bool)
            flags[at[later]] = True
            first, last = runs(flags, run)
            of = run[first]
            yield _span_rows(uid[of], first - offset[of] + start[of], last - offset[of] + start[of] + window, n_buckets)

    return spans


def removal(raw: bytes, spans: np.ndarray, digest: bool) -> tuple[int, int, str]:
    """Words, words removed, and the kept words joined by a space (or the SHA-256 of that)."""
    words = raw.split()
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, spans[:, 0], 1)
    np.add.at(gone, spans[:, 1], -1)
    gone = np.cumsum(gone[:-1]) > 0
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(spans) else words)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")


def pack(raw: bytes, codec: pa.Codec) -> bytes:
    return np.int64(len(raw)).tobytes() + codec.compress(raw, asbytes=True)


def unpack(packed: bytes, codec: pa.Codec) -> bytes:
    return codec.decompress(packed[8:], int(np.frombuffer(packed, np.int64, 1)[0]), asbytes=True)


NO_SPANS = np.zeros((0, 2), np.int64)


def _texts(window: int, length: int, repeated, digest: bool) -> Callable:
    """Finished documents, and the texts of those whose windows may recur."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, codec = WordHashes(), pa.Codec("zstd", 3)
        for batch in steps(batches, "text"):
            step = Step(batch, cache, repeated.value, window, length)
            uids, open_doc = step.uids(), np.zeros(len(step.texts), bool)
            open_doc[step.of[step.flags]] = True
            left, done = np.flatnonzero(open_doc), np.flatnonzero(~open_doc)
            yield _rows(TEXT, uid=uids[left], doc_id=[step.ids[i] for i in left], packed=[pack(as_bytes(step.texts[i]), codec) for i in left])
            found = [removal(as_bytes(step.texts[i]), NO_SPANS, digest) for i in done]
            n_words, n_removed, kept = ([x[j] for x in found] for j in range(3))
            yield _rows(DONE, uid=uids[done], doc_id=[step.ids[i] for i in done], n_words=n_words, n_removed=n_removed, kept=kept)

    return texts


def _applied(digest: bool) -> Callable:
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, codec = [], pa.Codec("zstd", 3)
        for _, rows in grouped(batches, "uid"):
            spans = [np.frombuffer(r["payload"], np.int64).reshape(-1, 2) for r in rows if r["kind"] == SPANS]
            spans = np.concatenate([NO_SPANS, *spans])
            for row in rows:
                if row["kind"] == TEXT:
                    out.append((row["doc_id"], *removal(unpack(row["packed"], codec), spans, digest)))
                elif row["kind"] == DONE:
                    out.append((row["doc_id"], row["n_words"], row["n_removed"], row["kept"]))
            if len(out) >= 200:
                yield batch(out)
                out = []
        yield batch(out)

    return applied


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    minimiser_words: int = MINIMISER_WORDS, bits: int = BITS, digest: bool = False,
) -> DataFrame:
    """Columns id_col, n_words, n_removed, kept: the kept words joined by one space, or its SHA-256.

    A word goes if a window over it also starts in a document with a smaller id. Windows are
    judged on the input. The ids are whole numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = 1 << max(6, (16 * partitions - 1).bit_length())
    keys = (
        rows.mapInArrow(_key_blobs(n_buckets, window, minimiser_words), "bucket int, keys binary, many binary")
        .repartition(partitions, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_repeated_keys, "keys binary")
    )
    repeated = broadcast_bitmap(keys, bits)
    spans = (
        rows.mapInArrow(_packed(n_buckets, window, minimiser_words, repeated), PACKED_SCHEMA)
        .repartition(partitions, F.col("bucket")).sortWithinPartitions("bucket")
        .mapInArrow(_bucket_spans(window, n_buckets), PACKED_SCHEMA).drop("bucket")
    )
    texts = rows.mapInArrow(_texts(window, minimiser_words, repeated, digest), TEXT_SCHEMA)
    found = (
        texts.unionByName(spans, allowMissingColumns=True)
        .repartition(partitions, F.col("uid")).sortWithinPartitions("uid")
        .mapInArrow(_applied(digest), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    )
    return found.withColumnRenamed("doc_id", id_col)
