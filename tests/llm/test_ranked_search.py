"""Ranked search against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from tallysheet.llm import ranked_search

UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def tables(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "Été", "日本", "a1"]
    weights = [1000 / (i + 3) for i in range(300)] + [400, 300, 9, 9, 9]

    def text(n):
        return " ".join(rng.choices(words, weights, k=n)).replace(" the ", ", The-")

    docs = [text(rng.choice([3, 20, 120])) for _ in range(260)]
    docs += [None, "", " .;\n", "the", " \u0085", "of " * 5000, "z" * 100_000, *[docs[4]] * 30, docs[5].upper()]
    rows = [(i, t, 1, "c") for i, t in enumerate(docs)]
    rows += [(4, docs[4], 1, "c"), (None, docs[4], 1, "c"), (-7, docs[4], 1, "c"), (2**40, "w299 w298 w7", 1, "c")]
    items = [(i, text(rng.choice([2, 8, 40])), 1) for i in range(12)]
    items += [(20, None, 1), (21, "", 1), (22, "unknownterm", 1), (23, "the the of", 1), (None, "w5 w6", 1), (24, "w7", 1), (24, "w8 w7", 1), (25, docs[4], 1)]
    return (
        rows, spark.createDataFrame(rows, "doc_id bigint, text string, score int, rank string").repartition(5),
        items, spark.createDataFrame(items, "item_id bigint, text string, doc_id int").repartition(2),
    )


def plain(rows, items, top):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in rows if terms(t)]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = {}
    for i, t, _ in items:
        queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, query in queries.items():
        scores = []
        for i, counts, n in docs:
            m, score = 75 + 25 * n * n_docs // n_terms, 0
            for t, times in query.items():
                if tf := counts[t]:
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("slice_docs", "items_per_block"), [(8192, 256), (40, 5)])
def test_against_all_documents(spark, monkeypatch, slice_docs, items_per_block):
    rows, docs, items, benchmark = tables(spark)
    monkeypatch.setattr(ranked_search, "SLICE_DOCS", slice_docs)
    found = ranked_search.ranked_search(docs, benchmark, items_per_block=items_per_block).collect()
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str)
    want = plain(rows, items, 20)
    assert len(want) > 200 and got == want


def test_dropped_documents_change_nothing(spark, monkeypatch):
    rows, docs, items, benchmark = tables(spark)
    monkeypatch.setattr(ranked_search, "SLICE_DOCS", 60)
    found = ranked_search.ranked_search(docs, benchmark, top=2).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str) == plain(rows, items, 2)


def test_empty(spark):
    _, docs, _, benchmark = tables(spark)
    assert ranked_search.ranked_search(docs.filter("false"), benchmark).count() == 0
    assert ranked_search.ranked_search(docs, benchmark.filter("false")).count() == 0
    assert ranked_search.ranked_search(docs.filter("text is null"), benchmark).count() == 0
