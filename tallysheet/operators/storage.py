"""Set-wise table changes (S12-S16, U5, U6): every job returns the whole new table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions.text import redact_text
from tallysheet.session import stage


def upsert_by_key(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], latest: Sequence[Column],
    keep_old_when_null: Sequence[str] = (),
) -> DataFrame:
    """Insert or update on a unique key.

    Several changes of one key collapse to the last one by `latest`. Stored rows without a
    change pass an anti join and stay where they are while the changed keys are few enough
    to broadcast; only the others are merged. Columns in `keep_old_when_null` keep the
    stored value when the change is null.
    """
    columns = target.columns
    values = [c for c in columns if c not in keys]
    incoming = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*latest)).alias("_new"))
    changed = incoming.select(*keys)
    untouched = target.join(changed, list(keys), "left_anti").select(*columns)
    stored = target.join(changed, list(keys), "left_semi").select(*keys, F.struct(*values).alias("_old"))
    merged = incoming.join(stored, list(keys), "left")

    def pick(column: str) -> Column:
        new, old = F.col(f"_new.{column}"), F.col(f"_old.{column}")
        if column in keep_old_when_null:
            return F.coalesce(new, old).alias(column)
        return new.alias(column)

    return untouched.unionByName(merged.select(*[F.col(c) if c in keys else pick(c) for c in columns]))


def replace_by_document(
    records: DataFrame, cells: DataFrame, new_records: DataFrame, new_cells: DataFrame,
    documents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Drop the records of re-extracted documents with their cells, add the new ones.

    `documents` lists the documents replaced; by default those of `new_records`.
    """
    named = documents if documents is not None else new_records
    replaced = named.select("document_id").distinct()
    gone = records.join(replaced, "document_id", "left_semi").select("record_id")
    kept_records = records.join(replaced, "document_id", "left_anti").select(*records.columns)
    kept_cells = cells.join(gone, "record_id", "left_anti")
    return (
        kept_records.unionByName(new_records.select(*records.columns)),
        kept_cells.unionByName(new_cells.select(*cells.columns)),
    )


def replace_slice(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the named keys are exchanged, the others stay."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(
        *current.columns
    ).unionByName(new.select(*current.columns))


def delete_documents(
    gone: DataFrame, documents: DataFrame, records: DataFrame, cells: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents go with their records and cells."""
    keys = gone.select("document_id").distinct()
    lost = records.join(keys, "document_id", "left_semi").select("record_id")
    return (
        documents.join(keys, "document_id", "left_anti").select(*documents.columns),
        records.join(keys, "document_id", "left_anti").select(*records.columns),
        cells.join(lost, "record_id", "left_anti").select(*cells.columns),
    )


def delete_events(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """An event goes with memberships, templates, fields, documents, records, cells.

    `tables` may hold any of events, members, templates, documents, records (by event_id),
    fields (by template_id) and cells (by record_id).
    """
    keys = gone.select("event_id").distinct()
    kept = {
        name: df.join(keys, "event_id", "left_anti").select(*df.columns)
        for name, df in tables.items() if "event_id" in df.columns
    }
    for child, parent, key in (("fields", "templates", "template_id"), ("cells", "records", "record_id")):
        if child in tables and parent in tables:
            lost = tables[parent].join(keys, "event_id", "left_semi").select(key)
            kept[child] = tables[child].join(lost, key, "left_anti").select(*tables[child].columns)
    return kept


def clear_references(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """A reference to a deleted row becomes null, the referring row stays."""
    lost = gone.select(F.col(key).alias(column), F.lit(True).alias("_lost")).distinct()
    joined = df.join(lost, column, "left")
    return joined.withColumn(
        column, F.when(F.col("_lost").isNull(), F.col(column))
    ).select(*df.columns)


def insert_skip_duplicates(
    target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()
) -> DataFrame:
    """Stored rows win; of several new rows of a key the first by `order` is taken."""
    columns = [c for c in target.columns if c not in keys]
    rank = F.struct(*order) if order else F.lit(0)
    fresh = (
        new.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_row"))
        .select(*keys, "_row.*")
        .join(target.select(*keys), list(keys), "left_anti")
    )
    return target.unionByName(fresh.select(*target.columns))


#: A diagnostic follows an error to the cause of its cause and no further.
CAUSES = 2


def quarantine(attempts: DataFrame, error: str = "error", name: str | None = None, causes: str | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """Split parse results into good rows and `failed` documents with a safe diagnostic.

    The diagnostic keeps the request options, the file and, of a PDF, its page range; the
    error has a name (`string` where the failure was only a text), its redacted message
    and a list of its causes, nearest first, of which two are kept. `causes` is a column
    of array<struct<name, message>>. Raw text never passes through.
    """
    failed = attempts.filter(F.col(error).isNotNull())
    extra = [c for c in (name, causes) if c]
    good = attempts.filter(F.col(error).isNull()).drop(error, *extra)
    columns = set(attempts.columns)

    def option(column: str, default: Column | None = None, kind: str = "int") -> Column:
        value = F.col(column) if column in columns else F.lit(None).cast(kind)
        return F.coalesce(value, default) if default is not None else value

    def named(value: Column) -> Column:
        return F.coalesce(value, F.lit("string"))

    followed = F.slice(F.col(causes), 1, CAUSES) if causes else F.array().cast("array<struct<name:string,message:string>>")
    safe = F.transform(
        followed, lambda c: F.struct(named(c["name"]).alias("name"), redact_text(c["message"]).alias("message"))
    )
    page_start, page_count = option("page_start"), option("page_count")
    first, count = F.coalesce(page_start, F.lit(1)), F.coalesce(page_count, F.lit(1))
    pages = F.struct(
        first.alias("start"), count.alias("count"),
        F.coalesce(option("total_pages"), count).alias("total"),
    )
    diagnostic = failed.select(
        "document_id", F.lit("failed").alias("status"),
        F.lit("extraction-failure").alias("provider"),
        option("file_name", kind="string").alias("file_name"), option("file_type", kind="string").alias("file_type"),
        option("row_count").alias("row_count"),
        option("layout", F.lit("table"), "string").alias("layout"),
        page_start.alias("page_start"), page_count.alias("page_count"),
        option("total_pages").alias("total_pages"),
        F.when(option("file_type", kind="string") == "application/pdf", pages).alias("pages"),
        named(F.col(name) if name else F.lit(None).cast("string")).alias("error_name"),
        redact_text(F.col(error)).alias("message"),
        F.coalesce(safe, F.array().cast("array<struct<name:string,message:string>>")).alias("causes"),
    )
    return good, diagnostic


#: Parts of a table that is laid out by the hash of a key, and the columns that say so.
PARTS = 256
PART, MARKER = "part", "_marker"


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _write_parts(rows: DataFrame, path: str, numbers: DataFrame, mode: str) -> None:
    """Write rows by part. Every part has a marker row, so one that loses all its rows is still replaced."""
    marked = rows.withColumn(MARKER, F.lit(False)).unionByName(
        numbers.withColumn(MARKER, F.lit(True)), allowMissingColumns=True
    )
    marked.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(PART).parquet(path)


def write_parts(df: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Write a table in parts by the hash of `key`, such as the document or event of its rows."""
    numbers = df.sparkSession.range(parts).select(F.col("id").cast("int").alias(PART))
    _write_parts(df.withColumn(PART, part_of(key, parts)), path, numbers, "static")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(~F.col(MARKER)).drop(MARKER, PART)


def rewrite_parts(
    spark: SparkSession, path: str, key: str, changed: DataFrame, change: Callable[[DataFrame], DataFrame],
    parts: int = PARTS,
) -> list[int]:
    """S13, S14, U5 on a stored table: `change` gets the rows of the parts that hold a changed key
    and returns them as they are to be; only these parts are read and written.

    `changed` has the column `key`. Returns the numbers of the parts, of which there are `parts` at most.
    """
    touched = sorted(row[0] for row in changed.select(part_of(key, parts)).distinct().collect())
    stored = spark.read.parquet(path).filter(F.col(PART).isin(touched) & ~F.col(MARKER)).drop(MARKER, PART)
    # written aside first: the parts that were read are about to be replaced
    after = stage(change(stored)).withColumn(PART, part_of(key, parts))
    numbers = spark.range(parts).select(F.col("id").cast("int").alias(PART)).filter(F.col(PART).isin(touched))
    _write_parts(after, path, numbers, "dynamic")
    return touched


def replace_documents(
    spark: SparkSession, path: str, new: DataFrame, documents: DataFrame, parts: int = PARTS
) -> list[int]:
    """S13 on a table stored by document: the rows of `documents` are exchanged for `new`."""
    gone = documents.select("document_id").distinct()
    changed = gone.unionByName(new.select("document_id").distinct())

    def change(stored: DataFrame) -> DataFrame:
        return stored.join(gone, "document_id", "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))

    return rewrite_parts(spark, path, "document_id", changed, change, parts)


def drop_documents(spark: SparkSession, path: str, documents: DataFrame, parts: int = PARTS) -> list[int]:
    """S14 on a table stored by document."""
    gone = documents.select("document_id").distinct()
    return rewrite_parts(
        spark, path, "document_id", gone,
        lambda stored: stored.join(gone, "document_id", "left_anti").select(*stored.columns), parts,
    )
