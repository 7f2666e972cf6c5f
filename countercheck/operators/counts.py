"""Record counts of two sides, plain or by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countercheck.functions import values as V
from countercheck.functions.names import ref, require_columns


def _per_side(source: DataFrame, target: DataFrame, keep=()) -> DataFrame:
    """Both sides stacked, with only ``keep`` (source, target) columns read."""
    sides = [(source, 1, 0), (target, 0, 1)]
    parts = [
        frame.select(
            *[ref(pair[i]).alias(pair[0]) for pair in keep],
            F.lit(s).cast("bigint").alias("in_source"),
            F.lit(t).cast("bigint").alias("in_target"),
        )
        for i, (frame, s, t) in enumerate(sides)
    ]
    return parts[0].unionByName(parts[1])


def _counted() -> list:
    return [
        F.coalesce(F.sum("in_source"), F.lit(0)).alias("source_count"),
        F.coalesce(F.sum("in_target"), F.lit(0)).alias("target_count"),
    ]


def record_count(
    source: DataFrame,
    target: DataFrame,
    tolerance_absolute: float = 0,
    tolerance_percent: float = 0.0,
) -> DataFrame:
    """One row: both counts, their difference and the verdict.

    It passes if either tolerance is met. The verdict uses the unrounded
    variance.
    """
    counted = _per_side(source, target).agg(*_counted())
    return count_verdict(counted, tolerance_absolute, tolerance_percent)


def count_verdict(
    counted: DataFrame, tolerance_absolute: float = 0, tolerance_percent: float = 0.0
) -> DataFrame:
    """``record_count`` from any number of rows of ``source_count`` and
    ``target_count``, which are added up: parts of a table, or groups."""
    difference = F.col("target_count") - F.col("source_count")
    variance = V.variance_percent(F.col("source_count"), F.col("difference"))
    passed = (F.abs("difference") <= tolerance_absolute) | (F.col("v") <= tolerance_percent)
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_count", "target_count")]
    return (
        counted.agg(*totals)
        .withColumn("difference", difference)
        .withColumn("v", variance)
        .select(
            "source_count",
            "target_count",
            "difference",
            F.round("v", 4).alias("variance_percent"),
            V.verdict(passed).alias("status"),
        )
    )


def record_count_by_group(
    source: DataFrame, target: DataFrame, group_by: Sequence[str]
) -> DataFrame:
    """Counts per group on both sides, ordered by group.

    A group with a missing part does not meet its counterpart: each side gets
    a row of its own, as in a SQL join USING.
    """
    s = require_columns(group_by, source.columns, "Group-by column(s)")
    t = require_columns(group_by, target.columns, "Group-by column(s) in target")
    pairs = list(zip(s, t, strict=True))
    stacked = _per_side(source, target, pairs)
    incomplete = F.lit(False)
    for name in s:
        incomplete = incomplete | ref(name).isNull()
    own_row = F.when(incomplete, F.col("in_source")).alias("__own_row")
    difference = F.col("target_count") - F.col("source_count")
    return (
        stacked.groupBy(*[ref(n) for n in s], own_row)
        .agg(*_counted())
        .withColumn("difference", difference)
        .withColumn(
            "variance_percent",
            F.round(V.variance_percent(F.col("source_count"), F.col("difference")), 4),
        )
        .orderBy(*[ref(n).asc_nulls_last() for n in s], F.col("__own_row").desc_nulls_last())
        .drop("__own_row")
    )
