"""What the join of near copies brings to the driver."""

import numpy as np
from pyspark import Broadcast
from pyspark.sql import functions as F

from tallysheet.llm import ngram_join


def test_widespread_shingles_come_as_columns(spark):
    rows = spark.createDataFrame([(-1, 3), (5, 7), (-(1 << 63), 4), (0, 9)], "shingle bigint, met bigint")
    shingle, met = ngram_join.by_shingle(rows)
    assert shingle.dtype == np.uint64 and shingle.tolist() == [0, 5, 1 << 63, (1 << 64) - 1]
    assert met.tolist() == [9, 7, 4, 3]
    none, _ = ngram_join.by_shingle(rows.filter("met > 99"))
    assert none.dtype == np.uint64 and not len(none)


def test_broadcasts_are_given_up(spark, monkeypatch):
    given_up, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *args: given_up.append(self) or destroy(self, *args))
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, "another text of some seven words here"), (4, None)], "doc_id bigint, text string")
    found = ngram_join.jaccard_groups(docs)
    assert len(given_up) == 2
    assert {r.doc_id: r.component_id for r in found.select("doc_id", F.col("component_id")).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
