"""Whole-number forms of the report arithmetic.

Confidences are reported in hundredths (78 means 0.78): sums of integers do not
depend on the order in which partitions finish.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def hundredths(confidence: Column) -> Column:
    return F.round(confidence * 100).cast("bigint")


def mean_of(total: Column, count: Column) -> Column:
    """Rounded mean of `count` integers that add up to `total`; null when there are none."""
    return F.when(count > 0, int_div(2 * total + count, 2 * count))


def rate(part: Column, total: Column) -> Column:
    """Whole percent, 0 when there is nothing to divide."""
    return F.when(total > 0, int_div(200 * part + total, 2 * total)).otherwise(
        F.lit(0).cast("bigint")
    )


def blend_confidence(structure: Column, value: Column, issue_count: Column) -> Column:
    """N5 on hundredths: 0.72 value + 0.28 structure, capped at 68 with issues, kept in 5..99."""
    ten_thousandths = value.cast("bigint") * 72 + structure.cast("bigint") * 28
    mixed = int_div(2 * ten_thousandths + 100, F.lit(200))
    capped = F.when(issue_count > 0, F.least(mixed, F.lit(68))).otherwise(mixed)
    return F.least(F.lit(99), F.greatest(F.lit(5), capped)).cast("int")


def confidence_label(confidence: Column) -> Column:
    """Whole percent text or `n/a`."""
    return F.coalesce(F.concat(F.round(confidence * 100).cast("bigint").cast("string"), F.lit("%")),
                      F.lit("n/a"))
