"""Document fingerprints: SpotSigs.

A signature is a chain: a common word (the anchor) with the next CHAIN content words behind
it; common words in between are passed over. The fingerprint of a text is its set of
signatures, 32 bits each, written in order as hexadecimal digits. Likeness is the Jaccard
similarity of two such sets. Sets are partitioned by length: two sets whose classes by
powers of 1 / threshold are more than one apart cannot reach the threshold, and a pair is
compared only as far as its lengths allow.

``neighbour_likeness`` compares every text with an edited copy of itself and with the next
document by id. Documents are dealt by id into ranges, sorted there, and the first document
of each range also goes to the range before, so each text is shuffled once (twice for the
first of a range) and nothing is ordered in one task.

Defined results: a null text is empty; texts without a chain (the empty one, too) have one
signature, the hash of their whole text; equal ids are ordered by the hash of their texts;
null ids come first; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.words import STEP_CHARS, WordHashes, as_bytes, mix, spread

CHAIN = 3
THRESHOLD = 0.8
#: Common words that anchor chains, in four languages; also passed over inside a chain.
ANCHORS = (
    "the a an is was are be to of and in that it for with as by this from "
    "der die das und ist ein eine den von zu mit nicht auf "
    "le la les de des et un une est du que en dans "
    "el los las y del se por con para su lo"
).split()
PUNCTUATION = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


class Signatures:
    """Signature sets of texts."""

    def __init__(self, chain: int = CHAIN):
        self.chain, self.cache = chain, WordHashes()
        self.anchors = np.sort(self.cache.of([w.encode() for w in ANCHORS]))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        split = [as_bytes(t.lower()).translate(PUNCTUATION).split() for t in texts]
        codes = self.cache.of([w for words in split for w in words])
        doc, _ = spread(np.array([len(w) for w in split], dtype=np.int64))
        near = np.minimum(np.searchsorted(self.anchors, codes), len(self.anchors) - 1)
        anchor = self.anchors[near] == codes
        content = np.flatnonzero(~anchor)
        at = np.flatnonzero(anchor)
        first = np.searchsorted(content, at)
        whole = first + self.chain <= len(content)
        at, first = at[whole], first[whole]
        inside = doc[content[first + self.chain - 1]] == doc[at]
        at, first = at[inside], first[inside]
        value = codes[at]
        for j in range(self.chain):
            value = mix(value) + codes[content[first + j]]
        value = (mix(value) >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(doc[at], np.arange(len(texts) + 1))
        found = []
        for i, text in enumerate(texts):
            own = np.unique(value[cuts[i] : cuts[i + 1]])
            found.append(own if len(own) else np.array([xxhash.xxh32_intdigest(as_bytes(text))], np.uint32))
        return found


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def length_class(n: int, threshold: float = THRESHOLD) -> int:
    """Sets whose classes differ by more than one are less alike than the threshold."""
    return int(np.floor(np.log(max(1, n)) / -np.log(threshold)))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0.0 where their lengths rule out ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = int((large[at] == small).sum())
    return same / (len(a) + len(b) - same)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters (or all) of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Columns id_col, n_signatures, length_class, fingerprint."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(chain)
        for batch in batches:
            sets = signatures.of([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([length_class(len(s)) for s in sets], pa.int32()), pa.array([written(s) for s in sets])],
                ["id", "n_signatures", "length_class", "fingerprint"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(found, f"id {kind}, n_signatures bigint, length_class int, fingerprint string").withColumnRenamed("id", id_col)


COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_signatures bigint, length_class int"
)


def _compared(chain: int):
    names = [c.split()[0] for c in COMPARED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]

    def rows_of(rows: list[tuple], last_set, signatures: Signatures):
        """rows: (bucket, copied, id, text), the first with its set known; results of all but the last."""
        texts = [r[3] for r in rows]
        sets = ([] if last_set is None else [last_set]) + signatures.of(texts if last_set is None else texts[1:])
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        after = signatures.of(changed)
        out = [
            (
                rows[i][2], len(texts[i]), hashlib.sha256(as_bytes(new)).hexdigest(), written(sets[i]), written(own),
                likeness(sets[i], own), likeness(sets[i], sets[i + 1]), len(sets[i]), length_class(len(sets[i])),
            )
            for i, new, own in zip(pairs, changed, after, strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names), sets[-1]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, rows, last_set, size = Signatures(chain), [], None, 0
        for batch in batches:
            for bucket, copied, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if copied and rows and rows[-1][0] == bucket and rows[-1][1]:
                    continue  # of several rows with the next id only the first is next
                rows.append((bucket, copied, doc_id, text))
                size += len(text)
                if size >= STEP_CHARS and len(rows) > 1:
                    found, last_set = rows_of(rows, last_set, signatures)
                    yield found
                    rows, size = rows[-1:], 0
        if len(rows) > 1:
            yield rows_of(rows, last_set, signatures)[0]

    return compared


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """The columns of COMPARED for every row. The ids are whole numbers."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint"))
    parts = 4 * partitions
    bounds = sorted(set(rows.select(place.alias("p")).approxQuantile("p", [i / parts for i in range(1, parts)], 0.1 / parts)))
    ranges = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucketed = rows.select(F.size(F.filter(ranges, lambda b: b <= place)).alias("bucket"), place.alias("p"), "doc_id", "text")
    # one row per range
    firsts = sorted((r["bucket"], r["first"]) for r in bucketed.groupBy("bucket").agg(F.min("p").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    if not before:
        return spark.createDataFrame([], COMPARED)
    known = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    goes = F.array(F.struct("bucket", F.lit(0).alias("copied")))
    also = F.array(F.struct(known[F.col("p")].alias("bucket"), F.lit(1).alias("copied")))
    is_first = F.col("p") == F.element_at(F.array(*[F.lit(x) for _, x in firsts]), F.element_at(_places([b for b, _ in firsts], len(bounds) + 1), F.col("bucket") + 1))
    dealt = bucketed.withColumn("goes", F.explode(F.when(is_first, F.concat(goes, also)).otherwise(goes)))
    return (
        dealt.select(F.col("goes.bucket").alias("to"), F.col("goes.copied").alias("copied"), "doc_id", "text", "p")
        .repartition(partitions, "to").sortWithinPartitions("to", "copied", "p", F.xxhash64("text"))
        .select("to", "copied", "doc_id", "text").mapInArrow(_compared(chain), COMPARED)
        .withColumnRenamed("doc_id", id_col)
    )


def _places(buckets: list[int], n: int):
    """For each range the place of its first id in the list (1-based; any place for empty ranges)."""
    at = {b: i + 1 for i, b in enumerate(buckets)}
    return F.array(*[F.lit(at.get(b, 1)) for b in range(n)])
