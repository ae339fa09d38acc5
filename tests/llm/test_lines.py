"""Line dedup against comparing all pairs of lines within the bits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.llm import lines

WORDS = "the of and stone river light under seven paper cloud winter glass road moon letter table north wheel".split()


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))


def changed_lines(rng, sizes, copies, words=1):
    """Lines of so many random words, and copies with some words changed."""
    texts = []
    for size in sizes:
        line = [word(rng) for _ in range(size)]
        texts.append(" ".join(line))
        for _ in range(copies):
            own = list(line)
            for _ in range(words):
                own[rng.randrange(size)] = word(rng)
            texts.append(" ".join(own))
    return texts


def plain_print(line):
    from tallysheet.llm.words import mix
    padded = b" " + line + b" "
    hashes = [int(mix(np.array([int.from_bytes(padded[i : i + 6], "little") + 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]) for i in range(len(padded) - 5)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(texts, bits=6):
    """Smallest place of an equal or alike line that each is linked with, by all pairs."""
    nodes = [b" ".join(lines.normal_lines(t)[0]) for t in texts]
    prints = [plain_print(n) if len(n) >= 6 or n.count(b" ") > 1 else None for n in nodes]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if not nodes[a].strip(b"0 ") or label[a] == label[b]:
                continue
            near = None not in (prints[a], prints[b]) and (prints[a] ^ prints[b]).bit_count() <= bits
            if nodes[a] == nodes[b] or (near and lines.alike(nodes[a].decode(), nodes[b].decode(), 0.8)):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def kept_lines(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    return {r.doc_id for r in lines.dedup_lines(docs).collect() if r.n_removed == 0}


def awkward(rng):
    texts = changed_lines(rng, [4, 30, 60, 150], 12) + changed_lines(rng, [80], 60) + changed_lines(rng, [40], 20, 3)
    # blocks in other orders: near by their n-grams, far by their edits
    blocks = [" ".join(word(rng) for _ in range(12)) for _ in range(5)]
    texts += [" ".join(rng.sample(blocks, 5)) for _ in range(40)]
    texts += ["Cookie Policy", "cookie policy!", "Login", "LOGIN", "2019", "2020", "- 7 -", "- 7 -", "a1", "a2", "x" * 50_000, "x" * 50_001]
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60))
    texts += [chinese, chinese[:30] + "一" + chinese[31:], "https://h.example.com/" + "ab" * 60, "https://h.example.com/" + "ab" * 60]
    rng.shuffle(texts)
    return texts


def test_lines_against_all_pairs(spark):
    texts = awkward(random.Random(9))
    label = plain_groups(texts)
    assert sum(x != i for i, x in enumerate(label)) > 80
    assert kept_lines(spark, texts) == {i for i, x in enumerate(label) if x == i}


def test_cells_cut_into_slices(spark, monkeypatch):
    texts = awkward(random.Random(10))
    monkeypatch.setattr(lines.line_links, "__defaults__", (5,))
    monkeypatch.setattr(lines, "BUCKET", 16)
    label = plain_groups(texts)
    assert kept_lines(spark, texts) == {i for i, x in enumerate(label) if x == i}


@pytest.mark.parametrize("crowd", [512, 0])
def test_trees_join_all_that_hangs_together(spark, crowd):
    rng = np.random.default_rng(2)
    codes = set()
    for base in rng.integers(0, 1 << 63, 5):
        for _ in range(70):
            code = int(base)
            for _ in range(rng.integers(0, 9)):
                code ^= 1 << int(rng.integers(64))
            codes.add(lines.signed(code))
    codes = np.array(sorted(codes))
    prints = spark.createDataFrame([(int(c),) for c in codes], "fp bigint")
    for slice_rows in (8192, 12):
        found = lines.candidate_trees(prints, 6, 4, slice_rows, crowd).collect()
        assert all(int(np.bitwise_count(np.int64(r.u ^ r.v).astype(np.uint64))) <= 6 for r in found)
        from tallysheet.llm.simhash import thinned
        at = {int(c): i for i, c in enumerate(codes)}
        got = thinned(len(codes), np.array([at[r.u] for r in found]), np.array([at[r.v] for r in found]))
        near = np.bitwise_count((codes[:, None] ^ codes[None, :]).astype(np.uint64)) <= 6
        assert (got == thinned(len(codes), *np.nonzero(near))).all()


def test_fingerprints_are_those_of_single_lines():
    rng = random.Random(3)
    some = [" ".join(word(rng) for _ in range(n)).encode() for n in (2, 3, 9, 200)] + ["日本語の行".encode(), b"abcdef"]
    assert lines.fingerprints(some).astype(np.uint64).tolist() == [plain_print(x) for x in some]
    assert len(lines.fingerprints([])) == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        most = rng.randrange(9)
        assert lines.edits(a, b, most) == min(plain(a, b), most + 1)


def test_documents_lose_lines(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(WORDS) + word(rng) for _ in range(40))
    rows = [
        (0, base + "\nThe common line is here.", "x", "own"), (1, base, "x", "own"), (2, "the COMMON line, is here\nnew words stand here", "x", "own"),
        (3, None, "x", None), (4, "", "x", None), (5, " \n\t\n12\n12", "x", None), (None, base, "x", None), (1, base, "x", "own"), (6, "é" * 200_000, "x", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string, line string").repartition(3)
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert found == sorted([
        (0, rows[0][1], 2, 0), (1, "", 1, 1), (1, "", 1, 1), (2, "new words stand here", 2, 1), (3, None, 0, 0), (4, "", 1, 0),
        (5, rows[5][1], 4, 0), (None, "", 1, 1), (6, rows[8][1], 1, 0),
    ], key=str)
    kept = lines.dedup_lines(docs, n_lines_col="_n", n_removed_col="_r").select(*docs.columns)
    assert {r.n_lines for r in kept.collect()} == {"x"}
    assert lines.dedup_lines(docs.filter("false")).count() == 0
    assert lines.dedup_lines(docs.withColumn("text", F.lit(None).cast("string"))).count() == 9


def test_words_written_anew_bound_the_edit_distance():
    rng = random.Random(5)
    words = ["a", "bb", "abc", "cab", "x", ""]
    for _ in range(3000):
        a = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
        b = [w for w in a if rng.random() < 0.8] if rng.random() < 0.5 else [rng.choice([w, w, w, "abd"]) for w in a]
        b = b or ["bb"]
        one, other = " ".join(a), " ".join(b)
        distance = lines.edits(one, other, 100)
        assert lines.rewritten(a, b, 100) >= distance
        assert lines.edits(other, one, 100) == distance
        for share in (0.5, 0.8):
            assert lines.alike(one, other, share) == (distance <= int((1 - share) * max(len(one), len(other)) + 1e-9))
