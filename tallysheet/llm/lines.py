"""Line dedup: lines that are nearly alike are kept once in the whole corpus.

Lines are normalised (lower case, digits as 0, punctuation as spaces, single spaces). Equal
normalised lines are one node. For near ones:

1. The SimHash of a line's byte n-grams has a bit set where over half the n-grams' hashes have
   it. Lines are candidates if at most DIFFERENT_BITS differ.
2. Pigeonhole blocks: the bits are cut into DIFFERENT_BITS + r blocks, and there is a table for
   each choice of r of them, so candidates agree in all bits of a table at least
   (`simhash.cell_masks`; r grows with the number of lines and changes no result). Fingerprints
   travel packed to the buckets of their tables. Cells of more than SLICE members go on to a
   second exchange, where each pair of their slices is a cell.
3. A cell returns a spanning tree of each set of candidates that hang together, around the
   smallest, and the tree's pairs are compared by edit similarity. Where all are alike the set is
   one group, whatever its other pairs. Where one is not, the set is open: its lines meet again
   and all pairs of lines that are in different groups by then are compared. So groups are those
   that comparing all candidates gives, without writing all pairs of a group of copies.
4. Connected lines form a group. The occurrence with the smallest (id, hash of the text,
   line number) stays, the other lines go from their documents.

A pair is linked if and only if it is within DIFFERENT_BITS and its edit similarity suffices;
README has the share of alike pairs, by kind of edit, that are within the bits.

Defined results: lines without a letter (nothing but digits and signs) are never removed, nor do
they remove others; lines of fewer than MIN_WORDS words and fewer than MIN_BYTES bytes go only if
they are equal; null and empty texts stay as they are; of equal rows (id and text) each keeps and
loses the same lines; null ids come after all others; columns of the documents that are named as
the two new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.bitmaps import broadcast_bitmap, holds
from tallysheet.llm.components import components
from tallysheet.llm.simhash import GrayIndex, cell_masks, signed
from tallysheet.llm.substrings import grouped
from tallysheet.llm.words import as_bytes, mix, steps, texts_of
from tallysheet.session import stage

#: Lines with so many words or so many bytes are compared with others (a Chinese character has three bytes).
MIN_WORDS, MIN_BYTES = 3, 6
SIMILARITY = 0.8
#: Bits of 64 in which candidates may differ.
DIFFERENT_BITS = 6
#: Lines a cell may hold on average before cells get more bits; members from which on it is cut into slices.
CROWD, SLICE = 512, 8192
#: Members up to which a cell's pairs are compared without an index, and pairs of cells that are held at once.
SMALL, HELD = 256, 500_000
BITS = 1 << 27
NORMAL = bytes(
    32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else 48 if 48 <= b <= 57 else b for b in range(256)
)
#: Bytes of an n-gram, and lines whose n-grams are counted at once.
GRAM, COUNTED = 6, 500
#: The lowest bit of each byte of a hash, and how many of them a byte can count.
LOWEST, BYTE_COUNT = np.uint64(0x0101010101010101), 255
#: Fingerprints that a task packs at once, and about as many a bucket holds.
PACKED, BUCKET = 200_000, 1 << 15
#: Parts of the pairs of one line when texts are joined to them.
SALTS = 64


def normal_lines(text: str | None) -> list[list[bytes]]:
    """The words of each \\n-split line after normalisation."""
    return [line.split() for line in as_bytes((text or "").lower()).translate(NORMAL).split(b"\n")]


def judged_lines(text: str | None) -> Iterator[tuple[int, bytes, int]]:
    """Number, normalised text and number of words of the lines with a letter."""
    for number, words in enumerate(normal_lines(text)):
        line = b" ".join(words)
        if line.strip(b"0 "):
            yield number, line, len(words)


def fingerprints(lines: list[bytes]) -> np.ndarray:
    """The SimHash of each line's n-grams, signed; a space is put before and after a line."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(lines), COUNTED):
        some = lines[at : at + COUNTED]
        raw = b"".join(b" " + x + b" " for x in some)
        size = np.array([len(x) + 2 for x in some])
        line = np.repeat(np.arange(len(some)), size)
        n = max(0, len(raw) - GRAM + 1)
        # the eight bytes from each place on, of which GRAM count
        code = np.ndarray(n, "<u8", raw + bytes(8), strides=(1,)) & np.uint64((1 << 8 * GRAM) - 1)
        whole = line[:n] == line[GRAM - 1 :]
        hashes, grams = mix(code[whole] + np.uint64(0x9E3779B97F4A7C15)), np.maximum(size - GRAM + 1, 0)
        if not len(hashes):
            out.append(np.zeros(len(some), np.int64))
            continue
        # eight bits of a hash are counted at once, in the bytes of a number, over BYTE_COUNT n-grams of a line at most
        full = np.flatnonzero(grams)
        parts = -(-grams[full] // BYTE_COUNT)
        part_line, first = np.repeat(full, parts), np.cumsum(parts) - parts
        begin = np.repeat((np.cumsum(grams) - grams)[full], parts) + (np.arange(len(part_line)) - np.repeat(first, parts)) * BYTE_COUNT
        counts, lane = np.empty((len(part_line), 8, 8), np.int32), np.empty_like(hashes)
        for k in range(8):
            np.right_shift(hashes, np.uint64(k), out=lane)
            np.bitwise_and(lane, LOWEST, out=lane)
            lanes = np.add.reduceat(lane, begin)
            counts[:, :, k] = lanes.view(np.uint8).reshape(-1, 8)
        total = np.zeros((len(some), 64), np.int64)
        total[full] = np.add.reduceat(counts.reshape(-1, 64), first, axis=0)
        out.append(np.packbits(2 * total > grams[:, None], axis=1, bitorder="little").view("<i8").ravel())
    return np.concatenate(out)


def _line_rows(least: tuple[int, int]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            doc, number, node, known, near = [], [], [], {}, []
            for i, text in enumerate(texts_of(batch, "text")):
                for j, line, n_words in judged_lines(text):
                    doc.append(i)
                    number.append(j)
                    node.append(known.setdefault(line, len(known)))
                    if node[-1] == len(near):
                        near.append(n_words >= least[0] or len(line) >= least[1])
            lines, node, near = list(known), np.array(node, np.int64), np.array(near, bool)
            key = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64).astype(np.int64)
            fp = np.zeros(len(lines), np.int64)
            fp[near] = fingerprints([x for x, n in zip(lines, near.tolist(), strict=True) if n])
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()),
                    pa.array(key[node]), pa.array(fp[node], mask=~near[node]),
                ],
                ["id", "uid", "line", "key", "fp"],
            )

    return rows


def gray_ranks(codes: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


def near_pairs(index: GrayIndex, allowed: int, whole: bool, apart_only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of the index's cells that are within the limit, as pairs of places.

    With `whole`, groups that cannot get over the limit give a chain of their members and
    one pair between two of them instead of all their pairs. With `apart_only`, a label of
    each member, only pairs of different labels are given.
    """
    top = len(index.mask) - 1
    roots = np.arange(len(index.mask[top]))
    todo = [(top, roots, roots, np.zeros(len(roots), np.int64))]
    while todo:
        level, a, b, apart = todo.pop()
        if len(a) > SLICE:
            todo.append((level, a[SLICE:], b[SLICE:], apart[SLICE:]))
            a, b, apart = a[:SLICE], b[:SLICE], apart[:SLICE]
        if level == 0:
            pair = a != b if apart_only is None else apart_only[a] != apart_only[b]
            yield a[pair], b[pair]
            continue
        if whole:
            done = apart + np.bitwise_count(~(index.mask[level][a] & index.mask[level][b])) <= allowed
            yield from index._whole(level, a[done], b[done])
            a, b, apart = a[~done], b[~done], apart[~done]
        todo.append((level - 1, *index._below(level, a, b, apart, allowed)))


def tree(u: np.ndarray, v: np.ndarray, codes: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Pairs that join all that hang together, and the root of each member of a pair.

    Those with the smallest codes come first, so that the cells of several tables mostly
    choose the same pairs, and paths are short.
    """
    low, high = np.minimum(codes[u], codes[v]), np.maximum(codes[u], codes[v])
    order = np.lexsort((high, low))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kept = []
    for a, b in zip(u[order].tolist(), v[order].tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept, {x: root(x) for x in parent}


TREES = ["u", "v", "comp"]


def _trees(fps: np.ndarray, cell: np.ndarray, salt: int, allowed: int) -> Iterator[pa.RecordBatch]:
    """Trees of cells: pairs of fingerprints and the set they join. fps are in the order of their cells."""
    if not len(cell):
        return
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    small = sizes <= SMALL
    # as many small cells at once as have about HELD pairs, each large one by itself
    part = np.cumsum(np.where(small, sizes * (sizes - 1) // 2, HELD)) // HELD * 2 + ~small
    cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | ~small[1:]][: len(part)])
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
        if sizes[i:j].max() > 1:
            begin, end = starts[i], starts[j] if j < len(starts) else len(cell)
            codes = fps[begin:end].view(np.uint64)
            found = _behind(codes, sizes[i:j], allowed) if small[i] else _through_index(codes, allowed)
            yield _tree_rows(codes, found, salt)


def _behind(codes: np.ndarray, sizes: np.ndarray, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs of small cells: each member with the one so many places behind it, for all places."""
    ends = np.cumsum(sizes)
    rest = ends.repeat(sizes) - np.arange(len(codes)) - 1
    found, step = [np.zeros((2, 0), np.int64)], 1
    active = np.flatnonzero(rest > 0)
    while len(active):
        near = active[np.bitwise_count(codes[active] ^ codes[active + step]) <= allowed]
        found.append(np.stack([near, near + step]))
        step += 1
        active = active[rest[active] >= step]
    u, v = np.concatenate(found, axis=1)
    return u, v


def _through_index(codes: np.ndarray, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of one cell that join all that hangs together; they are thinned to a tree whenever HELD are exceeded."""
    order = np.argsort(gray_ranks(codes))
    held, size = [np.zeros((2, 0), np.int64)], 0
    for u, v in near_pairs(GrayIndex(codes[order], np.zeros(len(codes), np.int64)), allowed, True):
        held.append(np.stack([order[u], order[v]]))
        size += len(u)
        if size > HELD:
            kept = tree(*np.concatenate(held, axis=1), codes)[0]
            held, size = [np.array(kept, np.int64).reshape(-1, 2).T], 0
    u, v = np.concatenate(held, axis=1)
    return u, v


def _tree_rows(codes: np.ndarray, found: tuple[np.ndarray, np.ndarray], salt: int) -> pa.RecordBatch:
    pairs, roots = tree(*found, codes)
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    top = np.array([roots[x] for x in a.tolist()], np.int64)
    comp = mix(mix(codes[top]) + np.uint64(salt & (1 << 64) - 1)).astype(np.int64)
    fps = codes.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(fps[a], fps[b])), pa.array(np.maximum(fps[a], fps[b])), pa.array(comp)], TREES)


def _packed(masks: list[int], per_table: int) -> Callable:
    """Fingerprints by table and bucket of the table."""
    shift = np.uint64(64 - (per_table.bit_length() - 1))

    def flush(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t, m in enumerate(masks):
            masked = mix(fps.view(np.uint64) & np.uint64(m))
            bucket = (masked >> shift).astype(np.int64) if per_table > 1 else np.zeros(len(fps), np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(per_table + 1))
            full = np.flatnonzero(np.diff(cuts))
            payload = [fps[order[cuts[i] : cuts[i + 1]]].tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(t * per_table + full, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size >= PACKED:
                yield from flush(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from flush(np.concatenate(held))

    return packed


def _bucket_trees(masks: list[int], per_table: int, allowed: int, slice_rows: int) -> Callable:
    """Trees of a bucket's cells; the members of cells that are too large go on as rows (t, fp)."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, "bucket"):
            t = bucket // per_table
            fps = np.frombuffer(b"".join(r["payload"] for r in rows), np.int64)
            codes = fps.view(np.uint64)
            cell = codes & np.uint64(masks[t])
            order = np.argsort(cell)
            fps, cell = fps[order], cell[order]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            big = np.repeat(sizes > slice_rows, sizes)
            for found in _trees(fps[~big], cell[~big], t, allowed):
                none = pa.nulls(found.num_rows, pa.int32()), pa.nulls(found.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*found.columns, *none], [*TREES, "t", "fp"])
            if big.any():
                n = int(big.sum())
                empty = [pa.nulls(n, pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(n, t, np.int32)), pa.array(fps[big])], [*TREES, "t", "fp"])

    return trees


def _slice_trees(allowed: int) -> Callable:
    """Trees of pairs of slices; each group of rows is one of them."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in grouped(batches, "part"):
            fps = np.array([r["fp"] for r in rows], np.int64)
            yield from _trees(fps, np.zeros(len(fps), np.int64), part, allowed)

    return trees


def candidate_trees(prints: DataFrame, allowed: int, partitions: int, slice_rows: int = SLICE, crowd: int = CROWD) -> DataFrame:
    """Columns u, v, comp: trees of candidates within a cell. prints: fp, each once."""
    n = prints.count()
    masks = cell_masks(n, allowed, crowd)
    per_table = 1 << max(0, (n // BUCKET).bit_length())
    both = stage(
        prints.select("fp").mapInArrow(_packed(masks, per_table), "bucket int, payload binary")
        .repartition(partitions, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_bucket_trees(masks, per_table, allowed, slice_rows), "u bigint, v bigint, comp bigint, t int, fp bigint")
    )
    found, over = both.filter("u is not null").select(*TREES), both.filter("fp is not null").select("t", "fp")
    if not over.head(1):
        return found
    mask = F.array(*[F.lit(signed(m)) for m in masks])
    cells = over.withColumn("cell", F.col("fp").bitwiseAND(F.get(mask, F.col("t"))))
    slices = stage(cells.groupBy("t", "cell").agg(F.ceil(F.count("*") / (slice_rows / 2)).cast("int").alias("slices")))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: x != F.col("own")))
    pairs = cells.join(slices, ["t", "cell"]).withColumn("own", own).withColumn("other", other)
    part = F.xxhash64("t", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("part")
    sliced = pairs.select(part, "fp").repartition(partitions, "part").sortWithinPartitions("part")
    return found.unionByName(sliced.mapInArrow(_slice_trees(allowed), "u bigint, v bigint, comp bigint"))


def _open_pairs(allowed: int) -> Callable:
    """All pairs of keys of a cell that are within the limit and in different groups."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "part"):
            fps, key, label = (np.array([r[c] for r in rows], np.int64) for c in ("fp", "key", "label"))
            order = np.argsort(gray_ranks(fps.view(np.uint64)))
            fps, key, label = fps[order], key[order], label[order]
            for u, v in near_pairs(GrayIndex(fps.view(np.uint64), np.zeros(len(fps), np.int64)), allowed, False, label):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[u], key[v])), pa.array(np.maximum(key[u], key[v]))], ["a", "b"])

    return pairs


def open_candidates(lines: DataFrame, allowed: int, partitions: int, slice_rows: int = SLICE, crowd: int = CROWD) -> DataFrame:
    """Columns a, b: all candidates in different groups. lines: fp, key, label."""
    masks = cell_masks(lines.count(), allowed, crowd)
    places = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("cell")) for t, m in enumerate(masks)))
    rows = lines.select("fp", "key", "label", F.explode(places).alias("place")).select("fp", "key", "label", "place.*")
    slices = rows.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    cut = rows.join(slices.select("t", "cell", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")), ["t", "cell"])
    own = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: (x != F.col("own")) | (F.col("slices") == 1))
    met = cut.withColumn("own", own).withColumn("other", F.explode(others))
    part = F.xxhash64("t", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("part")
    return (
        met.select(part, "fp", "key", "label").repartition(partitions, "part").sortWithinPartitions("part")
        .mapInArrow(_open_pairs(allowed), "a bigint, b bigint").distinct()
    )


def _place(uid: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(uid.astype(np.uint64) ^ mix(line.astype(np.uint64)))


def _place_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, line = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array([_place(uid, line).tobytes()], pa.binary())], ["keys"])


def _wanted_lines(wanted) -> Callable:
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in steps(batches, "text"):
            keys, found = [], []
            uids = batch.column(0).to_numpy()
            texts = texts_of(batch, "text")
            n_lines = np.array([(t or "").count("\n") + 1 for t in texts])
            doc = np.repeat(np.arange(len(texts)), n_lines)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
            hit = np.flatnonzero(holds(bitmap, _place(uids[doc], line)))
            for i in np.unique(doc[hit]):
                own = normal_lines(texts[i])
                for j in line[hit[doc[hit] == i]]:
                    text = b" ".join(own[j])
                    keys.append(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))
                    found.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["key", "words"])

    return lines


def common_start(a: str, b: str) -> int:
    """Characters that two texts have in common at their start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def without_ends(a: str, b: str) -> tuple[str, str]:
    """Two texts without what they have in common at their start and at their end, which no edit needs to touch."""
    low = common_start(a, b)
    a, b = a[low:], b[low:]
    high = common_start(a[::-1], b[::-1])
    return a[: len(a) - high], b[: len(b) - high]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance of two texts, or most + 1 if it is larger (bit-parallel, after Myers)."""
    a, b = without_ends(a, b)
    if min(len(a), len(b)) == 0 or abs(len(a) - len(b)) > most:
        return min(most + 1, max(len(a), len(b)))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for i, c in enumerate(b):
        eq = places.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        eq |= down
        more, less = down | ~(across | up) & full, up & across
        score += bool(more & last) - bool(less & last)
        if score - (len(b) - 1 - i) > most:
            return most + 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(eq | more) & full, more & eq
    return min(score, most + 1)


def rewritten(a: list[str], b: list[str], most: int) -> int:
    """Characters that are written anew if words are replaced, left out or put in one by one; the edit distance is never more.

    It may be counted too high, and stops at a number over most.
    """
    if len(a) == len(b):
        cost = sum([max(len(x), len(y)) for x, y in zip(a, b, strict=True) if x != y])
        if cost <= most:
            return cost
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        x, y = a[i], b[j]
        if x != y:
            if a[i + 1 : i + 3] == b[j : j + 2]:
                cost, j = cost + len(x) + 1, j - 1
            elif a[i : i + 2] == b[j + 1 : j + 3]:
                cost, i = cost + len(y) + 1, i - 1
            else:
                cost += max(len(x), len(y))
        i, j = i + 1, j + 1
    return cost + sum([len(x) + 1 for x in (*a[i:], *b[j:])])


def alike(a: str, b: str, share: float) -> bool:
    """1 - edit distance / longer length is at least ``share``."""
    most = int((1 - share) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if rewritten(a.split(" "), b.split(" "), most) <= most:
        return True
    return edits(a, b, most) <= most


def _alike(share: float) -> Callable:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [alike(a, b, share) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return links


def _texts_at(pairs: DataFrame, words: DataFrame, end: str) -> DataFrame:
    """pairs with the text of one end; the pairs of a line that has many are spread over SALTS keys."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
    texts = salted.select(end, "salt").distinct().join(words.select(F.col("key").alias(end), F.col("words").alias(f"words_{end}")), end)
    return salted.join(texts, [end, "salt"]).drop("salt")


def line_links(rows: DataFrame, nodes: DataFrame, similarity: float, allowed: int, bits: int, partitions: int, slice_rows: int = SLICE) -> DataFrame:
    """Links (a, b) of keys of alike lines. rows: uid, text; nodes: key, first (uid, line), fp."""
    lines = nodes.filter("fp is not null")
    prints = stage(lines.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    trees = stage(candidate_trees(prints, allowed, partitions, slice_rows))
    ends = trees.select("u", "v").distinct()
    rep = lambda end: prints.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}"))
    between = ends.join(rep("u"), "u").join(rep("v"), "v").select(
        F.least("rep_u", "rep_v").alias("a"), F.greatest("rep_u", "rep_v").alias("b"), "u", "v")
    # lines of equal fingerprints are compared with one of them
    shared = lines.join(prints.filter("n > 1").select("fp", "rep"), "fp").filter("key <> rep").select(
        F.least("key", "rep").alias("a"), F.greatest("key", "rep").alias("b"), F.col("fp").alias("u"), F.col("fp").alias("v"))
    tried = stage(between.unionByName(shared))

    def texts(keys: DataFrame) -> DataFrame:
        wanted = nodes.join(keys.distinct(), "key").select("first.uid", "first.line").mapInArrow(_place_keys, "keys binary")
        bitmap = broadcast_bitmap(wanted, bits)
        found = stage(rows.select("uid", "text").mapInArrow(_wanted_lines(bitmap), "key bigint, words string").dropDuplicates(["key"]))
        bitmap.destroy()
        return found

    def compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
        both = _texts_at(_texts_at(pairs, words, "a"), words, "b").select("a", "b", "words_a", "words_b")
        return stage(both.mapInArrow(_alike(similarity), "a bigint, b bigint"))

    keys = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("key"))
    first = compared(tried.select("a", "b"), texts(keys(tried)))
    failed = stage(tried.join(first, ["a", "b"], "left_anti"))
    if not failed.head(1):
        return first
    # a set is open if one of its pairs failed, or lines of equal fingerprints in it did
    alone = failed.filter("u = v").select(F.col("u").alias("fp"))
    sides = trees.select("comp", F.explode(F.array("u", "v")).alias("fp")).distinct()
    bad = trees.join(failed.select("u", "v").filter("u <> v"), ["u", "v"], "left_semi").select("comp").unionByName(sides.join(alone, "fp", "left_semi").select("comp")).distinct()
    open_prints = sides.join(bad, "comp", "left_semi").select("fp").unionByName(alone).distinct()
    group = components(first)
    again = stage(
        lines.join(open_prints, "fp", "left_semi").select("fp", "key")
        .join(group.withColumnRenamed("node", "key"), "key", "left").select("fp", "key", F.coalesce("label", "key").alias("label"))
    )
    further = stage(open_candidates(again, allowed, partitions, slice_rows).join(failed.select("a", "b"), ["a", "b"], "left_anti"))
    return first.unionByName(compared(further, texts(keys(further))))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, bits: int = BITS, allowed: int = DIFFERENT_BITS,
    n_lines_col: str = "n_lines", n_removed_col: str = "n_removed",
) -> DataFrame:
    """docs with the lines removed from text_col, and the new columns n_lines_col and n_removed_col."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uid = F.xxhash64(docs[id_col], docs[text_col])
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), uid.alias("uid"), docs[text_col].alias("text"))
    found = stage(rows.mapInArrow(_line_rows((min_words, min_bytes)), "id bigint, uid bigint, line int, key bigint, fp bigint"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "line")
    nodes = stage(found.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("many"), F.max("fp").alias("fp")))
    group = components(line_links(rows, nodes, similarity, allowed, bits, partitions))
    labelled = nodes.join(group.withColumnRenamed("node", "key"), "key", "left").select("key", "first", "many", F.coalesce("label", "key").alias("label"))
    keepers = labelled.groupBy("label").agg(F.min("first").alias("keeper"), F.sum("many").alias("many")).filter("many > 1").drop("many")
    again = labelled.join(keepers, "label").select("key", "keeper")
    gone = (
        found.select("uid", "line", "key").join(again, "key").filter((F.col("uid") != F.col("keeper.uid")) | (F.col("line") != F.col("keeper.line")))
        .groupBy("uid").agg(F.collect_set("line").alias("gone")).withColumnRenamed("uid", "gone_uid")
    )
    parts = F.split(F.col("old"), "\n", -1)
    kept = F.filter(parts, lambda _, i: ~F.array_contains(F.col("gone"), i))
    own = docs.select(F.struct(*docs.columns).alias("row"), docs[text_col].alias("old"), uid.alias("uid"))
    joined = own.join(gone, F.col("uid") == F.col("gone_uid"), "left")
    text = F.when(F.col("gone").isNull(), F.col("old")).otherwise(F.array_join(kept, "\n"))
    new = (n_lines_col, n_removed_col)
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in new]
    n_lines = F.coalesce(F.length("old") - F.length(F.replace(F.col("old"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return joined.select(*columns, n_lines.cast("bigint").alias(n_lines_col), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(n_removed_col))
