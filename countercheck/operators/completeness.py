"""Missing values per column: NULL, blank and placeholder text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions import values as V
from countercheck.functions.names import ref, require_columns

# Text that stands for a missing value by default.
SENTINELS = ("N/A", "NA", "NULL", "None", "-", "-999", "1900-01-01")


def null_stats(
    df: DataFrame, columns: Sequence[str] = (), sentinels: Sequence[str] = SENTINELS
) -> DataFrame:
    """One row per column with counts of missing values. No rows for an empty
    table.

    All columns are counted in one pass over the table; what is shuffled is
    one row per map task. A blank that is also listed as a sentinel counts
    twice.
    """
    names, conditions = null_conditions(df, columns, sentinels)
    counted = [F.count_if(c).alias(label) for label, c in conditions.items()]
    return stats_of(df.agg(F.count("*").alias("total_rows"), *counted), names)


def null_conditions(
    df: DataFrame, columns: Sequence[str] = (), sentinels: Sequence[str] = SENTINELS
) -> tuple[list[str], dict[str, Column]]:
    """The columns, and what to count for each: ``n0`` null, ``b0`` blank, ``s0`` sentinel, ..."""
    names = require_columns(columns, df.columns, "Column(s)") if columns else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    conditions = {}
    for i, name in enumerate(names):
        value = V.missing_as_null(ref(name), types[name])
        conditions[f"n{i}"] = value.isNull()
        conditions[f"b{i}"] = _blank(value, types[name])
        conditions[f"s{i}"] = _listed(value, types[name], sentinels)
    return names, conditions


def stats_of(one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    """``null_stats`` from ``total_rows`` and the counts of ``null_conditions``."""
    per_column = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(i).alias("position"),
                    F.col(f"n{i}").alias("null_count"),
                    F.col(f"b{i}").alias("blank_count"),
                    F.col(f"s{i}").alias("sentinel_count"),
                )
                for i, name in enumerate(names)
            ]
        )
    )
    missing = F.col("null_count") + F.col("blank_count") + F.col("sentinel_count")
    return (
        one_row.filter(F.col("total_rows") > 0)
        .select("total_rows", per_column.alias("c"))
        .select("total_rows", "c.*")
        .withColumn("missing_count", missing)
        .withColumn(
            "completeness_percent",
            F.round(
                V.percent_of(F.col("total_rows") - F.col("missing_count"), F.col("total_rows"), 100.0),
                4,
            ),
        )
        .orderBy("position")
        .select(
            "column",
            "null_count",
            "blank_count",
            "sentinel_count",
            "missing_count",
            "completeness_percent",
            "total_rows",
        )
    )


def _text(value: Column, dtype: T.DataType) -> Column:
    return value.cast("string") if V.family(dtype) != V.OTHER else V.as_text(value, dtype)


def _blank(value: Column, dtype: T.DataType) -> Column:
    """Only text can be blank."""
    return F.trim(value) == "" if V.family(dtype) == V.STRING else F.lit(False)


def _listed(value: Column, dtype: T.DataType, sentinels: Sequence[str]) -> Column:
    """Is the value's text a sentinel? Sentinels that the text of a value of
    this type can never be are left out first, so that numbers and times need
    not be turned into text for them."""
    kind = V.family(dtype)
    shapes = {V.INTEGER: r"-?\d+", V.BOOLEAN: "true|false"}
    if V.is_binary_float(dtype):
        shape = r"-?\d+\.\d+(E-?\d+)?|-?Infinity"
    elif isinstance(dtype, T.DateType):
        shape = r"[+-]?\d{4,}-\d\d-\d\d"
    elif kind == V.DATETIME:
        shape = r"[+-]?\d{4,}-\d\d-\d\d \d\d:\d\d:\d\d.*"
    else:
        shape = shapes.get(kind, "(?s:.*)")
    possible = [s for s in sentinels if re.fullmatch(shape, s)]
    return _text(value, dtype).isin(possible) if possible else F.lit(False)


def null_score(stats: DataFrame, threshold_percent: float = 100.0) -> DataFrame:
    """One row: the mean completeness of the columns and the verdict, which
    uses the unrounded mean. 100 when there is nothing to measure."""
    exact = V.percent_of(F.col("total_rows") - F.col("missing_count"), F.col("total_rows"), 100.0)
    return (
        stats.agg(
            F.coalesce(F.max("total_rows"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.avg(exact), F.lit(100.0)).alias("exact"),
        )
        .select(
            "total_rows",
            F.round("exact", 4).alias("completeness_score"),
            V.verdict(F.col("exact") >= threshold_percent).alias("status"),
        )
    )
