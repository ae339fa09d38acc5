"""SimHash groups against all pairs, and the index against all pairs of a cell."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallysheet.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, fp string, component_id string, fingerprint string"
WORDS = "the of and stone river light under seven paper cloud winter glass road moon letter table north wheel".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def table(spark):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "one", "ONE", "two words", "été naïve 日本語 😀 " * 9, "x" * 200_000, "a b c d " * 4000, prose(rng, 3000)]
    for _ in range(12):
        words = prose(rng, rng.choice([5, 200, 1500])).split()
        for _ in range(8):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = rng.choice("abcd")
    rows = [(i, t, "en", "clash", "clash", None) for i, t in enumerate(texts)]
    rows += [(3, "one", None, None, None, None), (None, "one", None, None, None, None), (None, prose(rng, 60), None, None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, prints):
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    members = {}
    for i, x in zip(ids, label, strict=True):
        members.setdefault(x, []).append(i)
    return [min((i for i in members[x] if i is not None), default=None) for x in label]


def test_groups_against_all_pairs(spark):
    rows, docs = table(spark)
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_groups([r[0] for r in rows], prints), strict=True), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == want
    assert len({g[2] for g in got}) < len(got) - 20
    assert simhash.simhash_groups(docs.filter("false")).count() == 0


def test_fingerprint_is_that_of_the_engine_hash(spark):
    hashed = spark.sql("select xxhash64('one two three four') as h").head().h
    assert simhash.fingerprint(b"One two\nthree four") == hashed


def test_cut_cells_and_all_block_counts(spark):
    rng = np.random.default_rng(3)
    codes = set()
    for base in rng.integers(0, 1 << 63, 8):
        for _ in range(60):
            code = int(base)
            for _ in range(rng.integers(0, 8)):
                code ^= 1 << int(rng.integers(64))
            codes.add(code)
    codes = sorted(codes)
    frame = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp bigint")
    want = plain_groups(codes, codes)
    for slice_rows, crowd in ((4096, 1024), (7, 1024), (7, 0)):
        found = simhash.links(frame, slice_rows=slice_rows, crowd=crowd).collect()
        at = {simhash.signed(c): i for i, c in enumerate(codes)}
        assert all((codes[at[r.u]] ^ codes[at[r.v]]).bit_count() <= 60 for r in found)
        label = simhash.thinned(len(codes), np.array([at[r.u] for r in found]), np.array([at[r.v] for r in found]))
        assert [codes[i] for i in label] == want


def test_cells_meet_within_the_limit():
    rng = random.Random(4)
    for n in (10, 10**8, 10**10, 10**13):
        masks = simhash.cell_masks(n)
        for _ in range(200):
            apart = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(not m & apart for m in masks)


def test_index_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        flips = np.uint64(1) << rng.integers(0, 64, (4, 50, 5), dtype=np.uint64)
        codes = np.unique(base[:, None] ^ np.bitwise_xor.reduce(flips, axis=2))
        cell = np.sort(rng.integers(0, 3, len(codes)))
        rank = codes.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        codes = codes[np.lexsort((rank, cell))]
        near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4) & (cell[:, None] == cell[None, :])
        assert (simhash.GrayIndex(codes, cell, 4).forest() == simhash.thinned(len(codes), *np.nonzero(near))).all()


def test_rank_orders_gray_codes(spark):
    codes = [0, 1, 3, 2, 6, 7, 5, 4, 12]
    rows = spark.createDataFrame([(c,) for c in reversed(codes)], "c bigint").orderBy(simhash.gray_rank(F.col("c"))).collect()
    assert [r.c for r in rows] == codes
