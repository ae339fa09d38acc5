"""Reading the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.schemas import TABLES

# Stored column -> working name used by the operators.
WORKING_NAMES = {
    "users": {"id": "user_id"},
    "events": {"id": "event_id"},
    "event_memberships": {"id": "membership_id"},
    "attendance_templates": {"id": "template_id"},
    "template_fields": {"id": "field_id"},
    "attendance_documents": {"id": "document_id"},
    "attendance_records": {
        "id": "record_id", "reviewed_by_user_id": "reviewed_by", "data_json": "data",
        "confidence_score": "confidence",
    },
    "attendance_record_values": {"id": "cell_id", "validation_issues": "issues"},
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table with its declared schema; a fixed schema keeps column pruning at the scan."""
    raw = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    return raw.withColumnsRenamed(WORKING_NAMES[name])


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in TABLES}


def event_rows(tables: dict[str, DataFrame], name: str, event_id: str) -> DataFrame:
    """Rows of one event; the filter reaches the file scan (partition pruning when stored so)."""
    return tables[name].filter(F.col("event_id") == event_id)


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write the working tables back under their stored column names."""
    for name, df in tables.items():
        back = {new: old for old, new in WORKING_NAMES[name].items()}
        df.withColumnsRenamed(back).write.mode("overwrite").parquet(f"{root}/{name}")


#: Column by which a table is stored in buckets: records meet their cells, and documents and events their rows, in place.
BUCKET_KEYS = {
    "users": "id", "events": "id", "event_memberships": "event_id", "attendance_templates": "event_id",
    "template_fields": "template_id", "attendance_documents": "id", "attendance_records": "id",
    "attendance_record_values": "record_id",
}
BUCKETS = 64


def _ddl(name: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name].fields)


def register_bucketed(spark: SparkSession, database: str, root: str, buckets: int = BUCKETS) -> None:
    """Declare the bucketed tables under `root` in the catalog of this session."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}'")
    for name, key in BUCKET_KEYS.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({_ddl(name)}) USING parquet "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{root}/{name}'"
        )


def write_bucketed(tables: dict[str, DataFrame], database: str, root: str, buckets: int = BUCKETS) -> None:
    """Write working tables in buckets of their key, sorted by it, under their stored names.

    Joins and groupings of two such tables by that key need no exchange. Columns that a
    working table has not are stored as null.
    """
    for name, df in tables.items():
        spark = df.sparkSession
        register_bucketed(spark, database, root, buckets)
        back = df.withColumnsRenamed({new: old for old, new in WORKING_NAMES[name].items()})
        stored = back.select(*[
            (F.col(f.name) if f.name in back.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields
        ])
        # one file per bucket: rows come together by bucket before they are written
        stored.repartition(buckets, BUCKET_KEYS[name]).write.mode("overwrite").insertInto(f"`{database}`.`{name}`")


def load_bucketed(spark: SparkSession, database: str, root: str, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """All eight tables under their working names."""
    register_bucketed(spark, database, root, buckets)
    return {name: spark.table(f"`{database}`.`{name}`").withColumnsRenamed(WORKING_NAMES[name]) for name in TABLES}
