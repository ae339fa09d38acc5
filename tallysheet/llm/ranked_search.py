"""Ranked lexical search over an index whose terms belong to owners that a query passes in turn.

Every term has one owner, by the share of documents that hold it: rare terms the first, common
ones the last (`owner_of`). A task that reads documents makes slices of at most SLICE_DOCS of
them, and a term's postings of a slice are one row. A bundle is an item's accumulators in a
slice, a sparse list of documents and whole-number scores. Bundles go from owner to owner: at
each, `cogroup` brings the bundles of a slice and a block of items together with the owner's
postings, contributions are added, and the bundles that result go on. So no task holds the
accumulators of an item over all documents, or the postings of a term.

Before a bundle goes on it drops documents that cannot be among the first ``top`` of their own
slice any more: those whose score and the most that later owners can add stay below the score
that ``top`` documents of the slice have already. This changes no result. The last owner
returns the first ``top`` of each slice, from which the final selection is made.

A bitmap of fixed size of the items' terms saves postings of other terms; terms are decided by
joins. Items are dealt into blocks of about ITEMS, so a block's lists in a row are bounded.

Defined results: null and empty texts have no terms, and items without a term of the corpus
give no rows; rows of equal item id are one item, whose terms add up (a null id, too); equal
document ids are documents of their own; null document ids come last among equal scores; other
columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysheet.llm.bitmaps import broadcast_bitmap, holds
from tallysheet.llm.words import KEPT_WORDS, WordHashes, steps
from tallysheet.session import stage

TOP = 20
#: Documents of a slice at most, and postings from which on a slice is closed.
SLICE_DOCS, SLICE_POSTINGS = 8192, 1_000_000
#: Items of a block, about.
ITEMS = 256
#: A term belongs to the first owner whose share of the documents it doesn't exceed, else to the last.
SHARES = (1 / 256, 1 / 16, 1 / 4)
#: Bits of the bitmap of the items' terms.
BITS = 1 << 23

#: Characters that separate terms become blanks, A-Z become a-z.
FOLDED = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))

POSTINGS = "slice bigint, term binary, docs binary, tf binary, n binary, df bigint, max_tf bigint, min_n bigint"
BUNDLES = "slice bigint, block int, item_id bigint, docs binary, scores binary"
FOUND = "slice bigint, item_id bigint, doc_id bigint, score bigint"
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Columns item_id, term, times."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t, n) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t, n in Counter(terms_of(text)).items()]
            yield from _table("item_id bigint, term binary, times bigint", found).to_batches()

    rows = items.select(items[item_col].cast("bigint").alias("item_id"), items[text_col].cast("binary").alias("text"))
    counts = rows.mapInArrow(counted, "item_id bigint, term binary, times bigint")
    return counts.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _term_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = WordHashes().of(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], ["keys"])


class Slice:
    """Postings of the documents read so far, by term."""

    def __init__(self, number: int):
        self.number, self.ids, self.lengths, self.size = number, [], [], 0
        self.terms: dict[bytes, tuple[list[int], list[int]]] = {}

    def add(self, doc_id: int | None, length: int, counts: list[tuple[bytes, int]]) -> None:
        for term, tf in counts:
            docs, tfs = self.terms.setdefault(term, ([], []))
            docs.append(len(self.ids))
            tfs.append(tf)
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.size += len(counts)

    def rows(self) -> pa.Table:
        """The documents in the order of their ids (nulls last) as a row without term, and a row per term."""
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        null, length = np.array([i is None for i in self.ids]), np.array(self.lengths, np.int64)
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        known = ids[order][: len(ids) - int(null.sum())]
        out = [(self.number, None, known.tobytes(), None, None, len(ids), None, int(length.sum()))]
        for term, (docs, tfs) in self.terms.items():
            docs, tf = np.array(docs), np.array(tfs, np.int64)
            n = length[docs]
            out.append((self.number, term, place[docs].tobytes(), tf.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), len(tf), int(tf.max()), int(n.min())))
        return _table(POSTINGS, out)


def _postings(bitmap) -> Callable:
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        wanted: dict[bytes, bool] = {}
        open_slice = Slice(number)
        for batch in steps(batches, "text"):
            words = [terms_of(t) for t in batch.column(1).to_pylist()]
            if len(wanted) > KEPT_WORDS:
                wanted.clear()
            new = list({w for ws in words for w in ws} - wanted.keys())
            wanted.update(zip(new, holds(bitmap.value, WordHashes().of(new)).tolist(), strict=True))
            for doc_id, found in zip(batch.column(0).to_pylist(), words, strict=True):
                if not found:
                    continue
                open_slice.add(doc_id, len(found), [(t, tf) for t, tf in Counter(found).items() if wanted[t]])
                if len(open_slice.ids) >= SLICE_DOCS or open_slice.size >= SLICE_POSTINGS:
                    yield from open_slice.rows().to_batches(1024)
                    number += 1
                    open_slice = Slice(number)
        if open_slice.ids:
            yield from open_slice.rows().to_batches(1024)

    return postings


def owner_of(df: Column, n_docs: int) -> Column:
    owner = F.lit(len(SHARES))
    for i, share in reversed(list(enumerate(SHARES))):
        owner = F.when(df <= share * n_docs, i).otherwise(owner)
    return owner


def units(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight one adds to documents of n terms that hold it tf times."""
    m = 75 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _carry(n_docs: int, n_terms: int, top: int, last: bool) -> Callable:
    """One owner's step for the bundles of a slice and a block of items."""

    def carry(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        slice_no, block = key[0].as_py(), key[1].as_py()
        bundles = {r["item_id"]: (r["docs"], r["scores"]) for r in left.to_pylist()}
        sums: dict[int | None, np.ndarray] = {}
        rests: dict[int | None, int] = {}
        ids = None
        for row in right.to_pylist():
            if row["weight"] is None:
                ids = np.frombuffer(row["docs"], np.int64)
                continue
            docs, tf, n = np.frombuffer(row["docs"], np.int32), *(np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("tf", "n"))
            added = row["weight"] * units(tf, n, n_docs, n_terms)
            for item in row["items"]:
                i = item["item_id"]
                if i not in sums:
                    sums[i], rests[i] = dense(bundles.pop(i, None)), item["rest"]
                sums[i][docs] += item["times"] * added
        out = []
        if last:
            for i in [*sums, *bundles]:
                score = sums[i] if i in sums else dense(bundles[i])
                for doc in first_places(score, top):
                    out.append((slice_no, i, int(ids[doc]) if doc < len(ids) else None, int(score[doc])))
            return _table(FOUND, out)
        out += [(slice_no, block, i, *packed) for i, packed in bundles.items()]
        for i, score in sums.items():
            docs = np.flatnonzero(score)
            if len(docs) > top:
                least = np.partition(score[docs], -top)[-top]
                docs = docs[score[docs] + rests[i] >= least]
            out.append((slice_no, block, i, docs.astype(np.int32).tobytes(), score[docs].tobytes()))
        return _table(BUNDLES, out)

    return carry


def dense(packed: tuple[bytes, bytes] | None) -> np.ndarray:
    score = np.zeros(SLICE_DOCS, np.int64)
    if packed:
        score[np.frombuffer(packed[0], np.int32)] = np.frombuffer(packed[1], np.int64)
    return score


def first_places(score: np.ndarray, top: int) -> list[int]:
    """The documents of the ``top`` highest scores above 0, by score and then by place."""
    docs = np.flatnonzero(score)
    if len(docs) > top:
        docs = docs[score[docs] >= np.partition(score[docs], -top)[-top]]
    return docs[np.lexsort((docs, -score[docs]))][:top].tolist()


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", items_per_block: int = ITEMS,
) -> DataFrame:
    """Columns item_col, rank (from 1), id_col, score: each item's ``top`` documents with score above 0."""
    spark = docs.sparkSession
    wanted = stage(item_terms(items, item_col, item_text_col))
    bitmap = broadcast_bitmap(wanted.select("term").distinct().mapInArrow(_term_keys, "keys binary"), BITS)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    postings = stage(rows.mapInArrow(_postings(bitmap), POSTINGS))
    bitmap.destroy()
    heads, held = postings.filter("term is null"), postings.filter("term is not null")
    size = heads.agg(F.sum("df").alias("docs"), F.sum("min_n").alias("terms")).head()
    n_docs, n_terms = size.docs or 0, size.terms or 1
    blocks = max(1, -(-wanted.select("item_id").distinct().count() // items_per_block))

    # weight and owner of each term, and the most it can add to a document
    most = F.expr(f"(1000000000 * max_tf) div (1000 * max_tf + 12 * (75 + (25 * min_n * {n_docs}) div {n_terms}))")
    known = held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.max(most).alias("most"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    known = known.select("term", weight.alias("weight"), owner_of(F.col("df"), n_docs).alias("owner"), "most")
    later = Window.partitionBy("item_id").orderBy(F.col("owner").desc()).rangeBetween(Window.unboundedPreceding, -1)
    entries = wanted.join(known, "term").withColumn("rest", F.coalesce(F.sum(F.col("times") * F.col("weight") * F.col("most")).over(later), F.lit(0)))
    lists = entries.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), "owner", "weight").agg(
        F.collect_list(F.struct("item_id", "times", "rest")).alias("items")
    )
    owned = stage(held.select("slice", "term", "docs", "tf", "n").join(stage(lists), "term").drop("term"))
    every_block = heads.select("slice", "docs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    bundles = spark.createDataFrame([], BUNDLES)
    for owner in range(len(SHARES) + 1):
        last = owner == len(SHARES)
        right = owned.filter(F.col("owner") == owner)
        if last:
            right = right.unionByName(every_block, allowMissingColumns=True)
        bundles = bundles.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(
            _carry(n_docs, n_terms, top, last), FOUND if last else BUNDLES
        )
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = bundles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
