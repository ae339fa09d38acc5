"""Groups of near copies by SimHash and a hierarchical index in Gray order.

A text's fingerprint has a bit set where over half the XXH64 hashes of its word shingles
have it. Fingerprints link when at most ALLOWED bits differ, and a group is what links reach.

Equal fingerprints are first met in one row. Every distinct fingerprint then goes to a few
cells: its bits are cut into ALLOWED + r blocks and a cell is a choice of r blocks with their
bits, so two fingerprints within ALLOWED bits share a cell at least (`cell_masks`). r grows
with the number of fingerprints; links don't depend on it. A cell of over SLICE members is
cut into slices by hash, and each pair of slices meets in a cell of its own.

In a cell fingerprints are sorted by Gray rank, so neighbours differ in few bits. FANOUT of
them in a row become a node that holds the bits they all share, nodes become nodes of the
level above, and a child keeps just the bits its parent doesn't have (`GrayIndex`). The
search goes down from pairs of nodes: the differences of their bits add up on the way, a
pair of groups over ALLOWED is left with all it holds, one that cannot get over it is linked
whole. A cell returns a spanning forest of its links, never all pairs.

Defined results: no words (null and empty texts) give fingerprint zero, which links like any
other; under `shingle` words the whole sequence is the one shingle; repeated rows and equal
ids each get their row; component_id is the smallest id that is not null (null if there is
none); other columns are not read, so their names don't matter; an empty table gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.components import components
from tallysheet.llm.words import steps
from tallysheet.session import stage

SHINGLE_WORDS = 4
ALLOWED = 4
SEED = 42
BITS = 64
#: Members of a cell from which on it is cut into slices.
SLICE = 4096
#: Fingerprints a cell may hold on average before cells get more bits.
CROWD = 1024
#: Children of a node of the index.
FANOUT = 8
#: Pairs of nodes whose children are compared at once, and links kept before they are thinned.
PAIRS, LINKS = 4096, 500_000
#: Shingles hashed at once.
HASHED = 200_000


def shingle_digests(text: bytes | None, shingle: int) -> Iterator[bytes]:
    """The XXH64 digests of a text's shingles, joined, HASHED at a time."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined, size = b" ".join(words), min(shingle, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    first, last = (end - length)[: len(words) - size + 1], end[size - 1 :]
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), HASHED):
        part = zip(first[at : at + HASHED].tolist(), last[at : at + HASHED].tolist(), strict=True)
        yield b"".join([digest(joined[i:j], SEED) for i, j in part])


def bits_set(digests: bytes) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the highest first."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduce(bits, axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    total, n = np.zeros(BITS, np.int64), 0
    for digests in shingle_digests(text, shingle):
        total += bits_set(digests)
        n += len(digests) // 8
    return int(np.packbits(2 * total > n).view(">i8")[0])


def _fingerprints(shingle: int) -> Callable:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return prints


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Columns doc_id, fp (signed) of every row."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint")


def cell_masks(n: int, allowed: int = ALLOWED, crowd: int = CROWD) -> list[int]:
    """Bits whose equality makes a cell: r of allowed + r blocks, the least r that spreads n rows enough."""
    for r in range(1, 5):
        if r == 4 or n <= crowd << (BITS * r // (allowed + r)):
            break
    edges = [BITS * i // (allowed + r) for i in range(allowed + r + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, r)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, to be sorted as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(signed(1 << (BITS - 1))))


def thinned(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member reached from each of n members."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


class GrayIndex:
    """Cells of codes in Gray order, each a tree of nodes that hold what their members share."""

    def __init__(self, codes: np.ndarray, cell: np.ndarray, fanout: int = FANOUT):
        self.n = len(codes)
        full = np.full(self.n, ~np.uint64(0))
        first, count = np.arange(self.n), np.ones(self.n, np.int64)
        #: By level, leaves first: bits that all members share, their values, and the bits that the parent hasn't.
        self.mask, self.value, self.own = [full], [codes], []
        #: By level: first member and members; first child and children.
        self.first, self.count, self.child, self.children = [first], [count], [first], [count]
        while True:
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            if len(start) == len(cell):
                break
            place = np.arange(len(cell)) - np.repeat(start, np.diff(np.r_[start, len(cell)]))
            cuts = np.flatnonzero(place % fanout == 0)
            mask, value = self.mask[-1], self.value[-1]
            ones, some = np.bitwise_and.reduceat(value, cuts), np.bitwise_or.reduceat(value, cuts)
            shared = np.bitwise_and.reduceat(mask, cuts) & (ones | ~some)
            sizes = np.diff(np.r_[cuts, len(cell)])
            self.own.append(mask & ~np.repeat(shared, sizes))
            self.mask.append(shared)
            self.value.append(ones & shared)
            self.first.append(self.first[-1][cuts])
            self.count.append(np.add.reduceat(self.count[-1], cuts))
            self.child.append(cuts)
            self.children.append(sizes)
            cell = cell[cuts]
        self.own.append(self.mask[-1])

    def forest(self, allowed: int = ALLOWED) -> np.ndarray:
        """The smallest member that each member reaches by links within its cell."""
        top = len(self.mask) - 1
        roots = np.arange(len(self.mask[top]))
        todo = [(top, roots, roots, np.zeros(len(roots), np.int64))]
        links, held = [], 0
        while todo:
            level, a, b, apart = todo.pop()
            if len(a) > PAIRS:
                todo.append((level, a[PAIRS:], b[PAIRS:], apart[PAIRS:]))
                a, b, apart = a[:PAIRS], b[:PAIRS], apart[:PAIRS]
            # what may still differ cannot reach over the limit: all members link
            whole = apart + np.bitwise_count(~(self.mask[level][a] & self.mask[level][b])) <= allowed
            for u, v in self._whole(level, a[whole], b[whole]):
                links.append((u, v))
                held += len(u)
            if held > LINKS:
                label = thinned(self.n, *map(np.concatenate, zip(*links, strict=True)))
                at = np.flatnonzero(label != np.arange(self.n))
                links, held = [(at, label[at])], 0
            if level and not whole.all():
                todo.append((level - 1, *self._below(level, a[~whole], b[~whole], apart[~whole], allowed)))
        u, v = map(np.concatenate, zip(*links, strict=True)) if links else (roots[:0], roots[:0])
        return thinned(self.n, u, v)

    def _whole(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of groups taken whole: a group with itself as a chain, two groups by their first members."""
        same = a == b
        yield self.first[level][a[~same]], self.first[level][b[~same]]
        first, count = self.first[level][a[same]], self.count[level][a[same]] - 1
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(first, count) + place, np.repeat(first, count) + place + 1

    def _below(self, level: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray, allowed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of children that are still within the limit, with the differences so far."""
        child, children = self.child[level], self.children[level]
        size = children[a] * children[b]
        pair = np.repeat(np.arange(len(a)), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = child[a][pair] + place // children[b][pair], child[b][pair] + place % children[b][pair]
        once = (a[pair] != b[pair]) | (i <= j)
        pair, i, j = pair[once], i[once], j[once]
        own, mask, value = self.own[level - 1], self.mask[level - 1], self.value[level - 1]
        new = (own[i] & mask[j]) | (mask[i] & own[j])
        apart = apart[pair] + np.bitwise_count((value[i] ^ value[j]) & new)
        near = apart <= allowed
        return i[near], j[near], apart[near]


def _forests(allowed: int) -> Callable:
    """Links of whole cells; rows come sorted by cell and Gray rank."""

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in itertools.chain(batches, [None]):
            rows = [c for c in (left, batch) if c is not None]
            if not rows:
                return
            table = pa.Table.from_batches(rows)
            cells = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("t", "bits", "low", "high")])
            fps = table.column("fp").to_numpy()
            new = np.r_[True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)][: len(fps)]
            # the last cell may go on in the next batch
            end = len(fps) if batch is None else int(np.flatnonzero(new)[-1]) if len(fps) else 0
            left = table.slice(end).combine_chunks().to_batches()[0] if end < len(fps) else None
            if end:
                cell = np.cumsum(new[:end])
                label = GrayIndex(fps[:end].view(np.uint64), cell).forest(allowed)
                at = np.flatnonzero(label != np.arange(end))
                yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[label[at]])], ["u", "v"])

    return forests


def links(distinct: DataFrame, allowed: int = ALLOWED, slice_rows: int = SLICE, crowd: int = CROWD) -> DataFrame:
    """Links u, v between the distinct fingerprints of column ``fp`` that join all within reach."""
    spark = distinct.sparkSession
    masks = cell_masks(distinct.count(), allowed, crowd)
    places = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for t, m in enumerate(masks)))
    rows = distinct.select("fp", F.explode(places).alias("place")).select("fp", "place.*")
    full = stage(
        rows.groupBy("t", "bits").count().filter(F.col("count") > slice_rows)
        .select("t", "bits", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    )
    one = rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    if full.head(1):
        cut = rows.join(full, ["t", "bits"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: (x != F.col("own")) | (F.col("slices") == 1))
        one = cut.withColumn("own", own).withColumn("other", F.explode(others)).select(
            "fp", "t", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
        )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = one.repartition(partitions, "t", "bits", "low", "high").sortWithinPartitions("t", "bits", "low", "high", gray_rank(F.col("fp")))
    return sorted_cells.select("t", "bits", "low", "high", "fp").mapInArrow(_forests(allowed), "u bigint, v bigint")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, allowed: int = ALLOWED,
) -> DataFrame:
    """Columns id_col, fingerprint (16 hexadecimal digits), component_id for every row."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle))
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("fp"), allowed), "u", "v").withColumnRenamed("node", "fp")
    met = distinct.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    least = met.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = met.drop("least").join(least, "label").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(placed, "fp").select(F.col("doc_id").alias(id_col), digits.alias("fingerprint"), "component_id")
