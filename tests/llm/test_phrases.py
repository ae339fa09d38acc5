"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

from tallysheet.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, k string, phrase string, rank string"
UPPER = {c: c + 32 for c in range(65, 91)}


def table(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "Été", "日本", "\x01", "a b", "x'y"]
    weights = [1] * 60 + [30, 20, 5, 5, 5, 5, 5]
    texts = []
    for i in range(160):
        parts = rng.choices(words, weights, k=rng.randrange(1, 60))
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(["new york", "New  York\tcity", "on the one hand", "stop.", "a, b", "line\nbreak", "\r\n", ";;"]))
        texts.append((" ".join(parts), ["en", "fr", None, ""][i % 4]))
    texts += [(None, "en"), ("", "en"), (" .\n,", "de"), ("one", "xx"), ("tie " * 3000, "zz"), ("long " + "y" * 100_000, "en"), *[texts[3]] * 9]
    texts += [("alone alone alone", "und"), (None, None)]
    return texts, spark.createDataFrame([(i, t, x, "c", "c", "c") for i, (t, x) in enumerate(texts)], SCHEMA).repartition(5)


def plain(texts, top, min_count=10, max_words=3):
    f, n = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    rows = {}
    for (lang, *words), a in some.items():
        covered = any(
            len(q) > len(words) + 1 and q[0] == lang and 100 * b >= 50 * a and any(list(q[i : i + len(words)]) == words for i in range(1, len(q)))
            for q, b in some.items()
        )
        if covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, *words[:k]], f[lang, *words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in rows.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def rows_of(found):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())


def test_against_all_phrases(spark):
    texts, docs = table(spark)
    want = plain(texts, 2000)
    assert len(want) > 60
    assert rows_of(phrases.best_phrases(docs)) == want
    assert rows_of(phrases.best_phrases(docs, top=7)) == [r for r in want if r[1] <= 7]


def test_longer_phrases_shards_and_small_unions(spark, monkeypatch):
    texts, docs = table(spark)
    monkeypatch.setattr(phrases, "BITS", 1 << 12)
    for shards, max_words in ((1, 2), (3, 4), (40, 3)):
        counts = phrases.phrase_counts(docs, max_words=max_words, shards=shards, bits=1 << 12)
        got = {(r.lang, r.k, r.phrase): r.f for r in counts.filter("k > 1").collect()}
        f = Counter()
        for text, lang in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
                words = re.findall(r"[^\x20\x09]+", piece)
                f.update(("und" if lang is None else lang, k, " ".join(words[i : i + k])) for k in range(2, max_words + 1) for i in range(len(words) - k + 1))
        assert got == {p: a for p, a in f.items() if a >= 10}


def test_empty(spark):
    _, docs = table(spark)
    assert phrases.best_phrases(docs.filter("false")).count() == 0
    assert phrases.best_phrases(docs.filter("text is null")).count() == 0


def test_gathered_parts_add_up(spark, monkeypatch):
    texts, _ = table(spark)
    lexicon = phrases.Lexicon()
    numbers = lexicon.numbers([t.encode() for t, _ in texts if t])
    words = [lexicon.words[i] for i in numbers if i > 1]
    assert words == [w for t, _ in texts if t for w in re.findall(rb"[^\x20\x09\x0a-\x0d.,;:!?]+", t.translate(UPPER).encode())]
