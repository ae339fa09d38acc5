"""Stored tables: buckets that join in place, parts of which only the changed ones are written."""

import os
import tempfile

from pyspark.sql import functions as F

from tallysheet.operators import reports, storage
from tallysheet.schemas import TABLES
from tallysheet.sources import tables


def test_buckets_join_without_an_exchange(spark):
    root = tempfile.mkdtemp()
    n = 500
    base = spark.range(n).select(F.col("id").cast("string").alias("k"))
    rows = {
        "users": base.select(F.col("k").alias("user_id"), F.lit("a@b.cc").alias("email")),
        "events": base.select(F.col("k").alias("event_id"), F.lit("t").alias("title")),
        "event_memberships": base.select(F.col("k").alias("membership_id"), F.col("k").alias("event_id"), F.col("k").alias("user_id"), F.lit("owner").alias("role")),
        "attendance_templates": base.select(F.col("k").alias("template_id"), F.col("k").alias("event_id")),
        "template_fields": base.select(F.col("k").alias("field_id"), F.lit("t").alias("template_id"), F.lit("key").alias("key")),
        "attendance_documents": base.select(F.col("k").alias("document_id"), F.lit("e").alias("event_id")),
        "attendance_records": base.select(
            F.col("k").alias("record_id"), F.lit("e").alias("event_id"), F.lit("approved").alias("status"), F.lit(0.5).alias("confidence")),
        "attendance_record_values": base.crossJoin(spark.range(3)).select(
            F.concat_ws("-", "k", "id").alias("cell_id"), F.col("k").alias("record_id"), F.col("id").cast("string").alias("field_id"),
            F.when(F.col("id") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues")),
    }
    assert set(rows) == set(TABLES)
    tables.write_bucketed(rows, "stored_test", root, buckets=8)
    loaded = tables.load_bucketed(spark, "stored_test", root, buckets=8)
    for name, df in rows.items():
        assert sorted(map(str, loaded[name].select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert {len(os.listdir(f"{root}/{name}")) for name in rows} != {0}
    records, cells = loaded["attendance_records"], loaded["attendance_record_values"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = reports._with_issue_cells(records, cells)
        joined = records.join(cells, "record_id")
        for df in (facts, joined):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert reports.event_summary(records, cells).first().validation_issue_cells == n
    assert tables.event_rows(loaded, "attendance_records", "e").count() == n


def state(path):
    return {part: sorted(os.listdir(f"{path}/{part}")) for part in os.listdir(path) if part.startswith("part=")}


def test_only_parts_of_changed_documents_are_written(spark):
    path = f"{tempfile.mkdtemp()}/records"
    rows = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("record_id"), (F.col("id") % 700).cast("string").alias("document_id"))
    storage.write_parts(rows, path, "document_id", parts=64)
    before = state(path)
    assert len(before) == 64
    changed = spark.createDataFrame([(str(i),) for i in range(10)], "document_id string")
    new = spark.createDataFrame([(f"n{i}", str(i % 4)) for i in range(9)], "record_id string, document_id string")
    touched = storage.replace_documents(spark, path, new, changed, parts=64)
    after = state(path)
    assert len(touched) <= 10 and {p for p in after if after[p] != before[p]} == {f"part={p}" for p in touched}
    want = storage.replace_by_document(rows, rows.select("record_id"), new, new.select("record_id"), changed)[0]
    assert sorted(map(tuple, storage.read_parts(spark, path).select("record_id", "document_id").collect())) == sorted(map(tuple, want.collect()))
    # a part that loses all its rows is written, too
    here = storage.part_of("document_id", 64) == touched[0]
    found = storage.read_parts(spark, path).filter(here).select("document_id").distinct().collect()
    gone = spark.createDataFrame(found, "document_id string")
    assert storage.drop_documents(spark, path, gone, parts=64) == [touched[0]]
    assert storage.read_parts(spark, path).filter(here).count() == 0 and len(state(path)) == 64
    assert storage.read_parts(spark, path).count() == want.count() - want.join(gone, "document_id").count()
    # a second run changes nothing
    storage.replace_documents(spark, path, new.limit(0), gone, parts=64)
    assert storage.read_parts(spark, path).count() == want.count() - want.join(gone, "document_id").count()
