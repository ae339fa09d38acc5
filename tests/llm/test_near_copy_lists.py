"""How the lists of the join of near copies are carried."""

import numpy as np
import pyarrow as pa

from tallysheet.llm import ngram_join


def test_a_set_is_one_row_until_its_lists_are_made(spark, monkeypatch):
    staged, stage = [], ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(4)]
    texts = [t if k == 0 else t + f" more{k}" for t in texts for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(docs).collect()}
    assert found == {i: i // 3 * 3 for i in range(12)}
    # no table of a row per set and shingle is written, and the lists of pivots are made once for all their readers
    assert not [x.columns for x in staged if {"shingle", "node"} <= set(x.columns)]
    assert [x.count() for x in staged if "prefix" in x.columns] == [12]
    assert len([x for x in staged if {"shingle", "pivot", "label"} <= set(x.columns)]) == 1


def test_entries_of_prefixes():
    prefix = [np.array(x, np.uint64).tobytes() for x in ([7, 2**64 - 1], [], [5])]
    batch = pa.RecordBatch.from_pydict({"node": [1, 2, 3], "n": [9, 4, 6], "prefix": prefix})
    (found,) = ngram_join._entries(iter([batch]))
    assert found.to_pydict() == {"shingle": [7, -1, 5], "node": [1, 1, 3], "n": [9, 9, 6], "reach": [9, 8, 6]}
    (none,) = ngram_join._entries(iter([batch.slice(0, 0)]))
    assert not none.num_rows
