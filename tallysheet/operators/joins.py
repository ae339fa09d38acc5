"""Joins from a large table to a lookup table when one key may hold much of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.session import stage

#: Rows of a key from which on it counts as hot, and the parts it is split into.
HOT_ROWS = 1_000_000
SALTS = 16


def hot_keys(fact: DataFrame, on: Sequence[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of more than `rows` rows, counted; None if there are none. There are at most 1 / `rows` as many as rows."""
    found = stage(fact.groupBy(*on).count().filter(F.col("count") > rows).select(*on))
    return found if found.head(1) else None


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread: Sequence[str | Column] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join `fact` to a `lookup` table with one row per key.

    How it is joined is left to Spark, which broadcasts a side that turns out small and
    splits skewed partitions. With `hot`, the keys that `hot_keys` counted, rows of these
    keys are dealt to SALTS parts by the `spread` columns, and only their lookup rows are
    repeated; all other keys stay whole.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if hot is None:
        return fact.join(lookup, keys, how)
    marked = hot.select(*keys, F.lit(SALTS).alias("_parts"))
    parts = spread if spread is not None else [c for c in fact.columns if c not in keys]
    count = F.coalesce("_parts", F.lit(1))
    salted = fact.join(marked, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*parts), count).cast("int")).drop("_parts")
    repeated = lookup.join(marked, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("_parts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
