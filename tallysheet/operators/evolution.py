"""Template edits and the migration of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.operators.joins import lookup_join


def reconcile_fields(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per field kept, renamed, added or removed.

    `existing`: template_id, field_id, key; `incoming`: template_id, position, field_id,
    key. An incoming field takes the stored field of its id, else the stored field of its
    key if no earlier incoming field took it. Stored fields left over are removed.
    """
    stored = existing.select(
        "template_id", F.col("field_id").alias("stored_id"), F.col("key").alias("stored_key")
    )
    asked = incoming.select("template_id", "position", "field_id", "key")
    by_id = asked.join(
        stored.select("template_id", F.col("stored_id").alias("field_id"),
                      F.col("stored_id").alias("_id_hit")),
        ["template_id", "field_id"], "left",
    )
    by_key = by_id.join(
        stored.select("template_id", F.col("stored_id").alias("_key_hit"),
                      F.col("stored_key").alias("key")),
        ["template_id", "key"], "left",
    )
    # The key fallback is taken only when no earlier field of the edit holds that stored row.
    first_by_id = by_key.filter(F.col("_id_hit").isNotNull()).groupBy("template_id", "_id_hit").agg(
        F.min("position").alias("_id_at")
    ).withColumnRenamed("_id_hit", "_key_hit")
    loose = by_key.filter(F.col("_id_hit").isNull() & F.col("_key_hit").isNotNull())
    first_by_key = loose.groupBy("template_id", "_key_hit").agg(F.min("position").alias("_key_at"))
    resolved = (
        by_key.join(first_by_id, ["template_id", "_key_hit"], "left")
        .join(first_by_key, ["template_id", "_key_hit"], "left")
        .withColumn(
            "_takes_key",
            F.col("_id_hit").isNull() & (F.col("position") == F.col("_key_at"))
            & (F.col("_id_at").isNull() | (F.col("position") < F.col("_id_at"))),
        )
        .withColumn(
            "stored_id",
            F.coalesce("_id_hit", F.when(F.col("_takes_key"), F.col("_key_hit"))),
        )
        .select("template_id", "position", F.col("key").alias("new_key"), "stored_id")
    )
    joined = stored.join(resolved, ["template_id", "stored_id"], "full")
    change = (
        F.when(F.col("position").isNull(), "removed")
        .when(F.col("stored_key").isNull(), "added")
        .when(F.col("stored_key") != F.col("new_key"), "renamed")
        .otherwise("kept")
    )
    return joined.select(
        "template_id", F.col("stored_id").alias("field_id"), F.col("stored_key").alias("old_key"),
        "new_key", "position", change.alias("change"),
    )


def removed_fields(existing: DataFrame, retained: DataFrame) -> DataFrame:
    """U6."""
    return existing.join(retained.select("template_id", "field_id"), ["template_id", "field_id"],
                         "left_anti")


def key_changes(reconciled: DataFrame) -> DataFrame:
    """Per template the removed keys and the (old, new) renames, at most one per field."""
    return reconciled.groupBy("template_id").agg(
        F.collect_list(F.when(F.col("change") == "removed", F.col("old_key"))).alias("removed"),
        F.sort_array(
            F.collect_list(
                F.when(F.col("change") == "renamed", F.struct("position", "old_key", "new_key"))
            )
        ).alias("renames"),
    ).filter((F.size("removed") > 0) | (F.size("renames") > 0))


def rename_keys(records: DataFrame, changes: DataFrame) -> DataFrame:
    """The records whose map changes, with the new map.

    Old and removed keys go first, then new keys are set from the original map, so a swap
    works and a new key wins over a leftover of the same name. Records that hold none of
    the keys are not returned: nothing is written for them.
    """
    joined = lookup_join(records, changes, "template_id", how="inner", spread=["record_id"])
    old_keys = F.transform("renames", lambda r: r["old_key"])
    gone = F.array_union("removed", old_keys)
    touched = joined.filter(F.arrays_overlap(F.map_keys("data"), gone))
    held = F.filter("renames", lambda r: F.map_contains_key("data", r["old_key"]))
    # of several renames to one key the last wins
    later = lambda i: F.transform(F.slice(held, i + 2, F.size(held)), lambda r: r["new_key"])
    moved = F.filter(held, lambda r, i: ~F.array_contains(later(i), r["new_key"]))
    new_keys = F.transform(moved, lambda r: r["new_key"])
    kept = F.map_filter(
        "data", lambda k, v: ~F.array_contains(gone, k) & ~F.array_contains(new_keys, k)
    )
    renamed = F.map_from_entries(
        F.transform(moved, lambda r: F.struct(r["new_key"], F.element_at("data", r["old_key"])))
    )
    return touched.select(
        *[c for c in records.columns if c != "data"], F.map_concat(kept, renamed).alias("data")
    )


def evolve_template(
    existing: DataFrame, incoming: DataFrame, records: DataFrame, cells: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reconciled fields, rewritten records, cells without those of removed fields)."""
    reconciled = reconcile_fields(existing, incoming)
    rewritten = rename_keys(records, key_changes(reconciled))
    gone = reconciled.filter(F.col("change") == "removed").select("field_id")
    kept = lookup_join(
        cells, gone.withColumn("_gone", F.lit(True)), "field_id", spread=["record_id"]
    ).filter(F.col("_gone").isNull()).select(*cells.columns)
    return reconciled, rewritten, kept


def apply_suggestions(fields: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions with a new key are appended as optional fields.

    The first suggestion of a key by position is taken. Added fields are numbered on from
    the number of fields, without gaps, and keep their aliases. Applied again, nothing is added.
    """
    none = F.array().cast("array<string>")
    given = fields if "aliases" in fields.columns else fields.withColumn("aliases", none)
    offered = suggestions if "aliases" in suggestions.columns else suggestions.withColumn("aliases", none)
    counts = fields.groupBy("template_id").agg(F.count("*").alias("_fields"))
    first = offered.join(fields.select("template_id", "key"), ["template_id", "key"], "left_anti").groupBy(
        "template_id", "key"
    ).agg(F.min(F.struct("position", "label", "type", "options", "aliases")).alias("_s"))
    # a template has at most 80 fields
    place = F.row_number().over(Window.partitionBy("template_id").orderBy("_s.position", "key"))
    new = first.withColumn("_place", place).join(counts, "template_id", "left").select(
        "template_id", "key", "_s.label", "_s.type", F.lit(False).alias("required"),
        (F.coalesce("_fields", F.lit(0)) + F.col("_place")).cast("int").alias("sort_order"),
        "_s.options", "_s.aliases",
    )
    return given.select(*new.columns).unionByName(new)
