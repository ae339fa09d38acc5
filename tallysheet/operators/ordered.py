"""Ordered work over groups of any size.

A plain window sorts a whole group in one task. Here a group is cut into bands
(a non-decreasing function of the order, such as `position div 4096`), each band is
handled alone, and only one summary row per band is combined across bands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.session import stage


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], band: Column, name: str
) -> DataFrame:
    """1..n per group in `order`; `band` must not decrease along it."""
    banded = df.withColumn("_band", band)
    before = (
        Window.partitionBy(*group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        banded.groupBy(*group, "_band").agg(F.count("*").alias("_n"))
        .withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_band").orderBy(*order)
    return (
        banded.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*group, "_band"])
        .withColumn(name, (F.col("_at") + F.col("_skip")).cast("bigint"))
        .drop("_band", "_at", "_skip")
    )


def number_rows_by_range(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1..n per group in `order` where no column makes good bands: ranges of sampled bounds are the bands.

    The order must be unique in a group. The ranges are written once, so that counts and rows agree.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_band", F.spark_partition_id())
    return number_rows(stage(ranged), group, order, F.col("_band"), name)


def carry_forward(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], band: Column,
    value: Column, name: str,
) -> DataFrame:
    """Latest non-null `value` at or before each row of its group."""
    banded = df.withColumn("_band", band).withColumn("_value", value)
    rank = F.struct(*order)
    before = (
        Window.partitionBy(*group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        banded.groupBy(*group, "_band")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), rank)).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
        .drop("_last")
    )
    inside = (
        Window.partitionBy(*group, "_band").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        banded.withColumn("_value", F.last("_value", ignorenulls=True).over(inside))
        .join(earlier, [*group, "_band"])
        .withColumn(name, F.coalesce("_value", "_carried"))
        .drop("_band", "_value", "_carried")
    )


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], band: Column,
    amount: Column, name: str,
) -> DataFrame:
    """Sum of `amount` over this row and all earlier rows of its group."""
    banded = df.withColumn("_band", band).withColumn("_amount", amount.cast("bigint"))
    before = (
        Window.partitionBy(*group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        banded.groupBy(*group, "_band").agg(F.sum("_amount").alias("_total"))
        .withColumn("_skip", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = (
        Window.partitionBy(*group, "_band").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        banded.withColumn("_sum", F.sum("_amount").over(inside))
        .join(offsets, [*group, "_band"])
        .withColumn(name, F.col("_sum") + F.col("_skip"))
        .drop("_band", "_amount", "_sum", "_skip")
    )


def previous_value(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], band: Column,
    value: Column, name: str,
) -> DataFrame:
    """`value` of the row just before, across band borders; null on the first row."""
    banded = df.withColumn("_band", band).withColumn("_value", value)
    rank = F.struct(*order)
    before = (
        Window.partitionBy(*group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        banded.groupBy(*group, "_band").agg(F.max_by("_value", rank).alias("_last"))
        .withColumn("_carried", F.last("_last").over(before))
        .drop("_last")
    )
    inside = Window.partitionBy(*group, "_band").orderBy(*order)
    return (
        banded.withColumn("_at", F.row_number().over(inside))
        .withColumn("_prior", F.lag("_value").over(inside))
        .join(earlier, [*group, "_band"])
        .withColumn(name, F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_prior")))
        .drop("_band", "_value", "_at", "_prior", "_carried")
    )
