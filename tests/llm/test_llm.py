"""Operators for training text against brute force, on small tables with awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.llm import lines, mixing, ngram_join, quality, secrets, sharding, spotsigs, substrings, toxicity
from tallysheet.llm.bpe import Vocabulary, round_trip

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and stone river light under seven paper cloud winter glass road moon letter table north wheel".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def table(spark):
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[50] = "changed"
    texts = [
        base, base, " ".join(near), prose(rng, 40) + "\n" + passage, passage + "\r\n" + prose(rng, 30), passage,
        None, "", "  \n\t ", "one", "ONE", "two words here", "a b c d e f g h i j k", "x " * 300, "été naïve 日本語 😀 " * 9,
        prose(rng, 30) + "\n" + "The common line is here.\n" + prose(rng, 12), "the COMMON line, is here\n" + prose(rng, 12),
        prose(rng, 4000), "stone\n" * 30, base.upper(),
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(1, base, "en", "s1", len(base)), (None, prose(rng, 60), "en", "s0", 1), (None, passage, None, "s0", None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(3).cache()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(spark, docs):
    for r in quality.quality_stats(docs).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).collect():
        words = words_of(r.text)
        seen = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {p for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(again))
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)
    kept = quality.keep_quality(docs.withColumn("kept", F.lit("x")))
    assert kept.columns == [*docs.columns, "kept"] and {r.doc_id for r in kept.collect()} >= {0, 3, 17}
    assert quality.quality_stats(docs.filter("false")).count() == 0


def test_longest_repeat_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        docs = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        words = np.array([w for d in docs for w in d])
        doc = np.repeat(np.arange(3), [len(d) for d in docs])
        end = np.cumsum([len(d) for d in docs])[doc]
        found = quality.longest_repeats(words, doc, end, 1)
        want = [
            max((k for j in range(len(d)) if j != i for k in range(1, len(d) + 1) if i + k <= len(d) and j + k <= len(d) and d[i : i + k] == d[j : j + k]), default=0)
            for d in docs for i in range(len(d))
        ]
        assert found.tolist() == want


def test_substrings(spark, docs):
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: words_of(r.text) for r in some.collect()}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][k : k + 50]), i)
    found = {r.doc_id: r for r in substrings.remove_repeated_windows(some).collect()}
    assert found.keys() == texts.keys()
    for i, words in texts.items():
        gone = {p for k in range(len(words) - 49) if first[tuple(words[k : k + 50])] < i for p in range(k, k + 50)}
        want = " ".join(w for p, w in enumerate(words) if p not in gone)
        assert (found[i].n_words, found[i].n_removed, found[i].kept) == (len(words), len(gone), want)
    assert substrings.remove_repeated_windows(docs).count() == docs.count()
    assert substrings.remove_repeated_windows(docs.filter("false")).count() == 0


def shingles(text):
    words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_jaccard_groups(spark):
    rng = random.Random(3)
    start = [prose(rng, rng.choice([6, 9, 30, 80])) for _ in range(12)]
    texts = []
    for text in start:
        for _ in range(6):
            words = text.split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice("abcd")
            texts.append(" ".join(words))
    texts += [None, "", "one two", "ONE two"]
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r for r in ngram_join.jaccard_groups(docs).collect()}
    assert [(found[i].n_shingles, found[i].component_id) for i in range(len(texts))] == [(len(s), x) for s, x in zip(sets, label, strict=True)]
    kept = ngram_join.one_of_each_group(docs.unionByName(docs.filter("doc_id < 3")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, x in enumerate(label) if i == x])
    assert ngram_join.jaccard_groups(docs.filter("false")).count() == 0


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


def test_neighbours(spark, docs):
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = dict(sorted((r.doc_id, r.text or "") for r in some.collect()))
    ids = list(texts)
    found = {r.doc_id: r for r in spotsigs.neighbour_likeness(some).collect()}
    for k, i in enumerate(ids):
        own, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        new = own[: len(own) - half] + following[:half]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
    assert found[0].fingerprint == found[1].fingerprint and found[0].near_next == 1.0
    assert spotsigs.neighbour_likeness(docs).count() == docs.count()
    assert spotsigs.neighbour_likeness(docs.filter("false")).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = prose(rng, 40) + (" you vile" + rng.choice(["some", "ly", ""]) + " wretch" if toxic else "")
        texts.append((i, text))
        labels.append((i, int(toxic)))
    texts += [(600, None), (601, ""), (602, prose(rng, 20) + " you v1le wr3tch"), (602, prose(rng, 5))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    rows = found.collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert max(r.predicted for r in rows if r.doc_id == 602) == 1 and max(r.predicted for r in rows if r.doc_id in (600, 601)) == 0
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in none.collect()} == {0.0}


def test_obfuscated_words_are_read():
    words = "idiot stupid useless assent booby".split()
    counts = sum(toxicity.trigrams(w.encode()) for w in words) * 1.0
    counts = counts / counts.sum() + 2 * (x := toxicity.trigrams(" ".join(WORDS * 3 + ["a", "you"]).encode())) / x.sum()
    reader = toxicity.Reader({"=" + w: 3.0 for w in [*words, "ass", "boob"]}, toxicity.log_model(counts * 10_000))

    def read(text):
        return reader.features(text)[1] == 3.0

    for text in (
        "5tupid", "1diot", "!diot", "useles5", "u5el355", "a55", "b00b", "i d 1 0 t", "i.d.1.0.t", "a i d i o t", "idi ot", "i di ot",
        "idi ot.", "(1di ot)", "i, d, i, o, t!", "i_d_i_o_t", "s t u p 1 d", "idiot!", "st*pid", "iiidiot", "i*d*i*o*t", "idi.ot",
    ):
        assert read(text) and read(f"under the river {text} cloud paper"), text
    assert not any(read(x) for x in ("", "the river under", "seven 7 of 10", "2nd winter", "a b c d"))


def test_mixing(spark):
    rows = [(i, "w " * (5 + i % 7), "en", "big" if i % 10 else ("small" if i % 20 else None)) for i in range(2000)] + [(5000, None, "en", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = mixing.mixed(docs.withColumn("epochs", F.lit(1)), min_entropy=0.9).select("doc_id", "text", "source", "mix.*").collect()
    have, got, docs_of = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for _, t, _, s in rows:
        have[s] += len(words_of(t))
    for r in out:
        got[r.source] += len(words_of(r.text))
        docs_of[r.source][r.doc_id] += 1
    total, alpha = sum(have.values()), out[0].alpha
    weights = {s: (n / total) ** alpha for s, n in have.items() if n}
    norm = sum(weights.values())
    entropy = -sum(w / norm * math.log(w / norm) for w in weights.values()) / math.log(3)
    most = max(w / norm * total / have[s] for s, w in weights.items())
    assert 0 < alpha < 1 and (entropy >= 0.9 - 1e-6 or abs(most - mixing.MAX_REPEAT) < 1e-3) and most <= mixing.MAX_REPEAT + 1e-3
    for s, w in weights.items():
        # whole tokens are aimed at, and the last document taken reaches them
        assert -0.5 <= got[s] - w / norm * total < 12 and max(docs_of[s].values()) - min(docs_of[s].values()) <= 1
    assert len(docs_of["empty"]) == 1 and mixing.mixed(docs.filter("false")).count() == 0


def test_sharding(spark, docs):
    names, prime = [f"s{i}" for i in range(7)], 251
    wanted = [(r.offset, r.step) for r in sharding.preferences(spark, names, prime).orderBy("shard").collect()]
    slots, nexts, turn = [None] * prime, [0] * 7, 0
    while None in slots:
        offset, step = wanted[turn % 7]
        while slots[(offset + nexts[turn % 7] * step) % prime] is not None:
            nexts[turn % 7] += 1
        slots[(offset + nexts[turn % 7] * step) % prime] = turn % 7
        turn += 1
    assert [r.shard for r in sharding.lookup_table(spark, names, prime).orderBy("slot").collect()] == slots
    placed = sharding.assign_shards(docs.withColumn("name", F.lit("x")).drop("lang"), names, ["doc_id"], prime).collect()
    assert len(placed) == docs.count() and all(slots[r.slot] == r.shard for r in placed)
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 250)


def test_secrets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        tail = [f'token = "{value}" on', f"mail {value[:4]}.77@mail3.example.com now", f"card {rng.randrange(10**15, 10**16)} paid"][i % 3]
        rows.append((i, f"{prose(rng, 15)} {tail} {prose(rng, 5)}", f"s{i % 4}"))
    rows += [(900, None, None), (901, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = secrets.scan(docs).collect()
    assert sorted(r.doc_id for r in found if r.is_secret) == list(range(0, 300, 3))
    assert {r.doc_id for r in found} == set(range(300))
    assert secrets.scan(docs.filter("false")).count() == 0


def test_all_candidates_of_a_word(spark):
    a, b = "a1b2c3d4e5f6a7", "9f8e7d6c5b4a39281706"
    wanted = {
        f'{{"id":"{a}","token":"{b}"}}': [a, b], f"https://h1.example.com/path?token={b}": ["//h1.example.com/path", b],
        'password = "hunter2" then': ["hunter2"], "pwd: swordfish": ["swordfish"], 'x "password":"hunter2","user":"me"': ["hunter2"],
        "secret =hunter2": ["hunter2"], "PASSWORD=correct-horse next": ["correct-horse"], f'token = "{b}" on': [b],
        ",".join([a, b] * 50): [a, b] * 50, "the password is not here": [], "plain words": [],
    }
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(wanted)], "doc_id bigint, text string, source string")
    found = collections.defaultdict(list)
    for r in secrets.candidates(docs, "doc_id", "text", "source").orderBy("id", "place", "part").collect():
        found[r.id].append(r.value)
    assert [found[i] for i in range(len(wanted))] == list(wanted.values())
    named = {r.value: r.named for r in secrets.features(secrets.candidates(docs.filter("doc_id = 0"), "doc_id", "text", "source"), []).collect()}
    assert named == {a: 0.0, b: 1.0}
    assert {"place", "part"} <= set(secrets.scan(docs).columns)


def test_bpe_round_trip(spark, docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    odd = ["a  b \n\n c's I'LL  x\t", "😀😀é́ ", "\x00\x1f\x85 \n", "zqxjk" * 40, "12345 67  ,,,!!  \r\n\r\n"]
    odd += ["".join(rng.choice("abez \n'é１,") for _ in range(60)) for _ in range(40)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    some = docs.filter("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).unionByName(more)
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    vocabulary = Vocabulary(spark, path, public_tokenizers.PATTERN)
    for max_words in (50, 1 << 10):
        for r in round_trip(some, vocabulary, max_words=max_words).collect():
            ids = encoding.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), texts[r.doc_id][:80]
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    table(spark).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = corpus_pipeline.stage(after)
    ids = [r.doc_id for r in docs.collect()]
    assert {0, 3, 17} <= set(ids) and not {1, 2, 5, 6, 7, 9, 13} & set(ids)
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
