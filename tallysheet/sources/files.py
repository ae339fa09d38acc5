"""Uploaded files (S8) and the plug-in point for layout readers (`extract_with`)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted file types by extension, the size limit, the stored-name rule.
FILE_TYPES = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "webp": "image/webp",
}
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_STORED_NAME = 80
FALLBACK_NAME = "attendance-sheet"
PAGE_MARK = r"/Type\s*/Page(?![A-Za-z0-9_])"


def stored_name(name: Column) -> Column:
    """Base name of safe characters, at most 80, with the extension in lower case."""
    extension = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
    base = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    safe = F.btrim(F.regexp_replace(base, "[^a-zA-Z0-9._-]+", "-"), F.lit("-"))
    short = F.substring(safe, 1, MAX_STORED_NAME)
    return F.concat(F.when(short == "", F.lit(FALLBACK_NAME)).otherwise(short), extension)


def pdf_page_count(content: Column) -> Column:
    marks = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(PAGE_MARK))
    return F.greatest(F.lit(1), marks)


def describe_files(files: DataFrame) -> DataFrame:
    """S8 over rows with path, length and content: type, pages, stored name, reject reason."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    types = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    kind = F.try_element_at(types, extension)
    return files.select(
        "path", name.alias("file_name"), kind.alias("file_type"), "length",
        F.when(kind == "application/pdf", pdf_page_count(F.col("content"))).otherwise(1).alias("total_pages"),
        stored_name(name).alias("stored_name"),
        F.when(kind.isNull(), "file_type").when(F.col("length") > MAX_FILE_BYTES, "file_size").alias("reject_reason"),
    )


def file_inventory(spark: SparkSession, directory: str) -> DataFrame:
    return describe_files(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    )


def scan_files(spark: SparkSession, directory: str, page_mark: str | None = None) -> DataFrame:
    """Files of a folder that are not over the limit: path, length, content, total_pages.

    The limit is a filter of the file source, so larger files are not read. Pages of a file
    are counted by `page_mark` between them, else by the marks of a PDF.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).filter(
        F.col("length") <= MAX_FILE_BYTES
    )
    if page_mark:
        marks = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(re.escape(page_mark)))
        pages = marks + 1
    else:
        pages = pdf_page_count(F.col("content"))
    return found.select("path", "length", "content", pages.cast("int").alias("total_pages"))


def page_rows(found: DataFrame) -> DataFrame:
    """One row per file and page, the unit of work of `extract_with`, spread over all tasks."""
    return found.withColumn("page", F.explode(F.sequence(F.lit(1), F.col("total_pages")))).repartition("path", "page")


def extract_with(
    pages: DataFrame, reader: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Run a user's layout reader over batches of pages.

    `reader` takes a batch (document_id, page, content, ..) and returns layout cells or
    words in `schema`. An exception fails the task; a reader that wants one bad page to
    be set aside returns it with an error column for `quarantine`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield reader(batch)

    return pages.mapInPandas(run, schema)
