"""N-gram Jaccard join: groups of documents whose sets of 5-word shingles are alike.

Two documents link when 100 * |x & y| >= percent * |x | y|; linked documents form groups.
The join follows set relations rather than comparing all pairs:

* Equal sets are one node (128 bits: a hash of the sorted shingles and their number).
* Sets without relations are skipped. A linked set shares all but (100 - percent) % of its
  shingles with its partner, so among the half of its shingles that come first by hash at
  most that many may be found in no other set. Shingles of those halves meet in buckets,
  which return to each node how many of its shingles recur. Most documents end here,
  those that merely quote a passage too. A shingle goes to its bucket once per step of a
  task, so that a passage in a third of all documents is no load.
* The rest is indexed by prefix: as many of its first shingles as guarantee that linked
  sets share one, widespread shingles last. In each list, sets are compared with one
  pivot only, and only if their sizes allow a link.
* Answers are derived from those of a similar set: a set takes over the relations of the
  pivot it is most similar to. For two pivots p, q of one list that are not yet in one
  group only |p & q| is computed. As |x & y| <= |p & q| + |x - p| + |y - q|, whole blocks
  of sets around p and q are skipped when the bound rules them out; a pair is compared
  only where the bound leaves it open and no group joins it yet.

All comparisons are exact on 64-bit hashes of shingles. Sets travel to the tasks of their
pivots in slots of at most SLOT sets; no task gathers a list or a group.

Defined results: null and empty texts and texts without words have no shingles and link
with nothing; texts of fewer words than a shingle have one, their whole sequence; rows
with equal ids are compared like others.
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
from tallysheet.llm.substrings import grouped
from tallysheet.llm.words import WordHashes, as_bytes, mix, run_hashes, spread, steps, texts_of
from tallysheet.session import stage

WORDS = 5
PERCENT = 80
#: Sets compared with a pivot in one group of rows.
SLOT = 256
#: Widespread shingles that are put last; only a hint for speed, broadcast.
WIDESPREAD = 100_000
BITS = 1 << 27


class ShingleSets:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int):
        self.words, self.cache = words, WordHashes()

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [as_bytes(t).lower().split() for t in texts]
        codes = self.cache.of([w for ws in split for w in ws])
        runs, start, found = run_hashes(codes, self.words), 0, []
        for words in split:
            n = len(words)
            if n >= self.words:
                part = np.sort(runs[start : start + n - self.words + 1])
                found.append(part[np.r_[True, part[1:] != part[:-1]]])
            else:
                found.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64))
            start += n
        return found


def node_of(shingles: np.ndarray) -> int:
    """The node of a set that is not empty."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))


def allowed_apart(n, percent: int):
    """Most shingles of a set of n that a linked set may lack."""
    return n * (100 - percent) // 100


def _nodes(words: int) -> Callable:
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(words)
        for batch in steps(batches, "text"):
            found = sets.of(texts_of(batch, "text"))
            node = [np.uint64(node_of(s)).astype(np.int64) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array(node, pa.int64())],
                ["id", "uid", "n", "node"],
            )

    return nodes


def _first_halves(words: int, n_buckets: int) -> Callable:
    """Per bucket pairs of 32-bit numbers: shingle, and its node or 0 if the step has several.

    Rows without a bucket's postings (kind 1) count, for nodes, shingles found recurring
    within the step.
    """

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bits = ShingleSets(words), n_buckets.bit_length() - 1
        for batch in steps(batches, "text"):
            found = {node_of(s): s[: (len(s) + 1) // 2] for s in sets.of(texts_of(batch, "text")) if len(s)}
            if not found:
                continue
            shingle = np.concatenate(list(found.values()))
            node = np.repeat(np.array([short(k) for k in found], dtype=np.uint32), [len(s) for s in found.values()])
            order = np.argsort(shingle, kind="stable")
            shingle, node = shingle[order], node[order]
            at = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
            size = np.diff(np.r_[at, len(shingle)])
            yield _postings(1, *_count(node[np.repeat(size > 1, size)]), n_buckets)
            single = np.where(size > 1, np.uint32(0), node[at])
            shingle = shingle[at]
            bucket = (shingle >> np.uint64(64 - bits)).astype(np.int64)
            low = ((shingle >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield _blob_rows(0, full, [low[cuts[i]:cuts[i + 1]].tobytes() + single[cuts[i]:cuts[i + 1]].tobytes() for i in full])

    return halves


def short(node: int) -> int:
    return max(1, node & 0xFFFFFFFF)


def _count(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(nodes, return_counts=True)
    return found, n.astype(np.uint32)


def _blob_rows(kind: int, bucket, payload) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(payload), pa.int32()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())],
        ["kind", "bucket", "payload"],
    )


def _postings(kind: int, a: np.ndarray, b: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Counts b of nodes a, dealt over the buckets in one row each."""
    part = a.astype(np.int64) % n_buckets
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    return _blob_rows(kind, full, [a[order[cuts[i]:cuts[i + 1]]].tobytes() + b[order[cuts[i]:cuts[i + 1]]].tobytes() for i in full])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (32 bits) and how many of their shingles recur in this bucket."""
    for _, rows in grouped(batches, "bucket"):
        keys, nodes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for row in rows:
            a, b = np.frombuffer(row["payload"], np.uint32).reshape(2, -1)
            if row["kind"]:
                nodes.append(a)
                counts.append(b)
            else:
                keys.append((a.astype(np.uint64) << np.uint64(32)) | b)
        key = np.sort(np.concatenate(keys))
        shingle, node = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        differs = np.r_[False, key[1:] != key[:-1]] & np.r_[False, shingle[1:] == shingle[:-1]]
        at = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]][: len(key)])
        size = np.diff(np.r_[at, len(key)])
        # a shingle recurs if its rows have two nodes, or one of them stands for several
        many = np.add.reduceat(differs, at) > 0 if len(at) else np.zeros(0, bool)
        use = np.repeat(many, size) & (node > 0) & np.r_[True, key[1:] != key[:-1]][: len(key)]
        found, n = _count(node[use])
        total = np.concatenate([found, *nodes])
        amount = np.concatenate([n, *counts])
        found, inverse = np.unique(total, return_inverse=True)
        n = np.bincount(inverse, weights=amount, minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], ["short", "recur"])


def _place_key(node: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Key of the row that stands for a node."""
    return mix(node ^ mix(rank.astype(np.uint64)))


def _row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, rank = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array([_place_key(node.astype(np.uint64), rank).tobytes()], pa.binary())], ["keys"])


def _related_sets(words: int, wanted) -> Callable:
    def related(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bitmap = ShingleSets(words), wanted.value
        for batch in steps(batches, "text"):
            rank = batch.column(0).to_numpy(zero_copy_only=False)
            found = [(node_of(s), s) for s in sets.of(texts_of(batch, "text"))]
            node = np.array([k for k, _ in found], dtype=np.uint64)
            keep = np.flatnonzero(holds(bitmap, _place_key(node, rank)) & np.array([len(s) > 0 for _, s in found], dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[keep].astype(np.int64)), pa.array([len(found[i][1]) for i in keep], pa.int64()),
                    pa.array([found[i][1].tobytes() for i in keep], pa.binary()),
                ],
                ["node", "n", "shingles"],
            )

    return related


def _met_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            shingle, n = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in batch.column(0).to_pylist()]), return_counts=True)
            often = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(shingle[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "met"])


def _prefixes(percent: int, widespread) -> Callable:
    """A row per set: how many of its shingles are its own, and its prefix in the order of the lists."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = widespread.value
        for batch in batches:
            own_only, prefix = [], []
            for n, raw in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                own = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                weight = np.where(known[at] == own, met[at], 0) if len(known) else np.zeros(n, np.int64)
                prefix.append(own[np.lexsort((own, weight))][: allowed_apart(n, percent) + 1].tobytes())
                own_only.append(int((weight == 0).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own_only, pa.int64()), pa.array(prefix, pa.binary())], ["node", "n", "rare", "prefix"]
            )

    return prefixes


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of the column prefix, with the other columns and its reach: how many shingles its set has from there on."""
    for batch in batches:
        raw = batch.column(batch.schema.get_field_index("prefix")).to_pylist()
        many = np.array([len(x) // 8 for x in raw], dtype=np.int64)
        shingle = np.frombuffer(b"".join(raw), np.uint64).astype(np.int64)
        row, starts = spread(many)
        place = np.arange(len(row)) - starts[row]
        others = [name for name in batch.schema.names if name != "prefix"]
        columns = {name: batch.column(batch.schema.get_field_index(name)).to_numpy()[row] for name in others}
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle, *columns.values(), columns["n"] - place)], ["shingle", *others, "reach"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a pivot and slot: the pivot's set, then the sets to compare."""
    pivot, place, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = np.frombuffer(row["shingles"], np.uint64)
            if row["a"] is None:
                pivot, place = own, (row["b"], row["slot"])
                continue
            assert place == (row["b"], row["slot"])
            at = np.searchsorted(pivot, own)
            same = int((pivot[np.minimum(at, len(pivot) - 1)] == own).sum())
            out.append((row["a"], row["b"], len(own), len(pivot), same))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n_a", "n_b", "same"])
        out = []


def overlaps(pairs: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """For pairs (a, b) of nodes: n_a, n_b and the number of common shingles."""
    slots = pairs.groupBy("b").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    dealt = pairs.join(slots, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("slots")).cast("int").alias("slot"))
    compared = dealt.join(sets.select(F.col("node").alias("a"), "shingles"), "a").select("b", "slot", "a", "shingles")
    pivots = slots.select("b", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    pivots = pivots.join(sets.select(F.col("node").alias("b"), "shingles"), "b").select("b", "slot", F.lit(None).cast("bigint").alias("a"), "shingles")
    return (
        compared.unionByName(pivots).repartition(partitions, "b", "slot").sortWithinPartitions("b", "slot", F.col("a").asc_nulls_first())
        .mapInArrow(_overlap, "a bigint, b bigint, n_a bigint, n_b bigint, same bigint")
    )


def linked(percent: int):
    return F.expr(f"100 * same >= {percent} * (n_a + n_b - same)")


def related_nodes(rows: DataFrame, nodes: DataFrame, words: int, percent: int, partitions: int) -> DataFrame:
    """Nodes (and the rank of the row that stands for each) with enough recurring shingles to have a link."""
    n_buckets = 1 << max(6, (4 * partitions - 1).bit_length())
    recur = (
        rows.mapInArrow(_first_halves(words, n_buckets), "kind int, bucket int, payload binary")
        .repartition(partitions, F.col("bucket")).sortWithinPartitions("bucket")
        .mapInArrow(_recurring, "short bigint, recur bigint").groupBy("short").agg(F.sum("recur").alias("recur"))
    )
    classes = nodes.filter("node is not null").groupBy("node", "n").agg(F.min("rank").alias("rank"))
    short_node = F.greatest(F.lit(1), F.col("node").bitwiseAND(0xFFFFFFFF))
    half, apart = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") * (100 - percent) / 100)
    return classes.withColumn("short", short_node).join(recur, "short").filter(F.col("recur") >= half - apart).select("node", "n", "rank")


def by_shingle(often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns shingle (unsigned, ascending) and met; they reach the driver as columns, a row of Python numbers takes ten times as much."""
    table = often.select("shingle", "met").toArrow()
    shingle, met = (table.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(shingle.astype(np.uint64))
    return shingle.astype(np.uint64)[order], met.astype(np.int64)[order]


def links_between(sets: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Links (a, b) that connect the same sets as all links do."""
    spark = sets.sparkSession
    often = (
        sets.select("shingles").mapInArrow(_met_often, "shingle bigint, met bigint").groupBy("shingle").agg(F.sum("met").alias("met"))
        .orderBy(F.desc("met"), "shingle").limit(WIDESPREAD)
    )
    widespread = spark.sparkContext.broadcast(by_shingle(often))
    prefixes = stage(sets.select("node", "n", "shingles").mapInArrow(_prefixes(percent, widespread), "node bigint, n bigint, rare bigint, prefix binary"))
    widespread.destroy()
    postings = prefixes.mapInArrow(_entries, "shingle bigint, node bigint, n bigint, rare bigint, reach bigint")
    # the pivot of a list is its set with the fewest shingles of its own: the others are mostly edits of it
    heads = postings.groupBy("shingle").agg(F.min(F.struct("rare", "node", "n", "reach")).alias("head"), F.count("*").alias("many")).filter("many > 1")
    heads = heads.select("shingle", F.col("head.node").alias("b"), F.col("head.n").alias("n_b"), F.col("head.reach").alias("reach_b"))
    # at the first shingle that two sets share, no more can be shared than both have from there on
    possible = lambda a, b: F.expr(f"100 * least({a}, {b}) >= {percent} * (n + n_b - least({a}, {b}))")
    first = postings.join(heads, "shingle").filter((F.col("node") != F.col("b")) & possible("reach", "reach_b"))
    tested = stage(overlaps(first.select(F.col("node").alias("a"), "b").distinct(), sets, partitions))
    found = tested.filter(linked(percent))
    # each set leans on the pivot that it shares most with; the others lean on themselves
    group = components(found)
    leans = found.groupBy("a").agg(F.max(F.struct("same", F.col("b").alias("pivot"), (F.col("n_a") - F.col("same")).alias("apart"))).alias("x"))
    members = stage(
        sets.select("node", "n").distinct()
        .join(leans.select(F.col("a").alias("node"), "x.pivot", "x.apart"), "node", "left")
        .join(group, "node", "left")
        .select("node", "n", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("apart", F.lit(0)).alias("apart"), F.coalesce("label", "node").alias("label"))
    )
    # the set's prefix meets its pivot in one row; lists are read three times, so they are made once
    leaning = prefixes.select("node", "n", "prefix").join(members.select("node", "pivot", "label"), "node").select("pivot", "label", "n", "prefix")
    lists = stage(
        leaning.mapInArrow(_entries, "shingle bigint, pivot bigint, label bigint, n bigint, reach bigint")
        .groupBy("shingle", "pivot", "label").agg(F.max("reach").alias("reach"), F.min("n").alias("n"))
    )
    open_lists = lists.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    lists = lists.join(open_lists, "shingle")
    other = lists.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("pivot", "label", "reach", "n")))
    blocks = (
        lists.join(other, "shingle").filter((F.expr("pivot < pivot_b and label <> label_b")) & possible("reach", "reach_b"))
        .select(F.col("pivot").alias("a"), F.col("pivot_b").alias("b")).distinct()
    )
    between = stage(overlaps(blocks, sets, partitions))
    found = found.select("a", "b").unionByName(between.filter(linked(percent)).select("a", "b"))
    group = components(found)
    label = members.drop("label").join(group, "node", "left").withColumn("label", F.coalesce("label", "node"))
    around = lambda s: label.select(F.col("pivot").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "apart", "label")))
    widest = label.groupBy("pivot").agg(F.max("apart").alias("apart"), F.min("n").alias("n"))
    bound = f"100 * (same + apart_a + apart_b) >= {percent} * (n_a + n_b - (same + apart_a + apart_b))"
    size = lambda s: widest.select(F.col("pivot").alias(s), F.col("apart").alias(f"apart_{s}"), F.col("n").alias(f"n_{s}"))
    left = between.select("a", "b", "same").join(size("a"), "a").join(size("b"), "b").filter(bound).select("a", "b", "same", "apart_b", "n_b")
    # members of a that the widest member of b leaves open, then those of b
    some = left.join(around("a"), "a").filter(bound).drop("apart_b", "n_b")
    pairs = (
        some.join(around("b"), "b")
        .filter(f"label_a <> label_b and {bound} and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    )
    return found.unionByName(overlaps(pairs, sets, partitions).filter(linked(percent)).select("a", "b"))


def grouped_rows(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bits: int) -> DataFrame:
    """Columns id, uid (hash of id and text), n, node, label (of the node's group); one row per row of docs."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uid = F.xxhash64(docs[id_col], docs[text_col])
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"), uid.alias("uid"))
    nodes = stage(rows.mapInArrow(_nodes(words), "id bigint, uid bigint, n bigint, node bigint").withColumn("rank", F.coalesce("id", F.lit(-1).cast("bigint"))))
    related = related_nodes(rows.select("id", "text"), nodes, words, percent, partitions)
    wanted = broadcast_bitmap(related.select("node", "rank").mapInArrow(_row_keys, "keys binary"), bits)
    ranked = rows.select(F.coalesce("id", F.lit(-1).cast("bigint")).alias("rank"), "text")
    sets = stage(ranked.mapInArrow(_related_sets(words, wanted), "node bigint, n bigint, shingles binary"))
    wanted.destroy()
    group = components(links_between(sets, percent, partitions))
    labels = nodes.filter("node is not null").select("node").distinct().join(group, "node", "left")
    return nodes.drop("rank").join(labels.select("node", F.coalesce("label", "node").alias("label")), "node", "left")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """Columns id_col, n_shingles, component_id (smallest id that links lead to), group_size.

    The ids are whole numbers. One row per row of docs.
    """
    rows = grouped_rows(docs, id_col, text_col, words, percent, bits)
    groups = rows.filter("label is not null").groupBy(F.col("label").alias("group")).agg(F.min("id").alias("low"), F.count("*").alias("many"))
    found = rows.join(groups, F.col("label") == F.col("group"), "left")
    alone = F.col("label").isNull()
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("low")).alias("component_id"),
        F.coalesce("many", F.lit(1).cast("bigint")).alias("group_size"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """docs with one row of each group: the smallest (id, hash of the text), null ids last.

    Rows without shingles are in no group and stay.
    """
    rows = stage(grouped_rows(docs, id_col, text_col, words, percent, bits).filter("label is not null").select("label", "id", "uid"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    keepers = rows.groupBy(F.col("label").alias("group")).agg(F.min(order).alias("keeper"), F.count("*").alias("many"))
    gone = rows.join(keepers.filter("many > 1"), F.col("label") == F.col("group")).filter(F.col("uid") != F.col("keeper.uid"))
    gone = gone.select(F.col("uid").alias("gone_uid")).distinct()
    again = rows.groupBy(F.col("uid").alias("again_uid")).count().filter("count > 1").select("again_uid")
    # the columns go inside a struct, so their names cannot clash
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(docs[id_col], docs[text_col]).alias("uid"))
    left = marked.join(gone, F.col("uid") == F.col("gone_uid"), "left_anti")
    once = left.join(again, F.col("uid") == F.col("again_uid"), "left_anti")
    repeated = left.join(again, F.col("uid") == F.col("again_uid"), "left_semi").groupBy("uid").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(repeated.select("row.*"))
