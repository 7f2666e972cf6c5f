"""Rows that share a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countercheck.functions import values as V
from countercheck.functions.names import ColumnError, free_name, ref, require_columns
from countercheck.sinks import storage


def _keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    if not keys:
        raise ColumnError("At least one key column is required.")
    return list(dict.fromkeys(require_columns(keys, df.columns, "Key column(s)")))


def _per_key(df: DataFrame, names: list[str], count: str) -> DataFrame:
    return df.groupBy(*[ref(k) for k in names]).agg(F.count("*").alias(count))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once. Missing keys count as one key."""
    names = _keys(df, keys)
    count = free_name(names, "occurrence_count")
    return _per_key(df, names, count).filter(F.col(count) > 1)


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: all rows, repeated keys, rows of repeated keys, verdict."""
    names = _keys(df, keys)
    n = free_name(names, "occurrence_count")
    repeated = F.when(F.col(n) > 1, F.col(n))
    return (
        _per_key(df, names, n)
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
            F.count(repeated).alias("duplicate_key_count"),
            F.coalesce(F.sum(repeated), F.lit(0)).alias("duplicate_row_count"),
        )
        .withColumns(
            {
                "duplicate_percent": F.round(
                    V.percent_of(F.col("duplicate_row_count"), F.col("total_rows"), 0.0), 4
                ),
                "status": V.verdict(F.col("duplicate_row_count") == 0),
            }
        )
    )


def duplicate_rows(
    df: DataFrame, keys: Sequence[str], sample_limit: int | None = None
) -> DataFrame:
    """Rows of repeated keys with their count, ordered by key and then by all
    other columns. Keys with a missing part are left out.

    The first ``n`` rows in key order belong to the first ``n`` repeated keys
    at most. So with a limit, at most that many keys are broadcast to the
    table, and the table itself is not shuffled. Without a limit, the repeated
    keys are counted and stored first; then they meet the table in one join of
    plain reads, in which adaptive execution splits a key that many rows share.
    """
    names = _keys(df, keys)
    n = free_name(df.columns, "occurrence_count")
    count = free_name(names, "occurrence_count")
    repeated = (
        duplicate_groups(df, names)
        .withColumnRenamed(count, n)
        .dropna(subset=["`" + k.replace("`", "``") + "`" for k in names])
    )
    if sample_limit is None:
        kept = storage.stored(repeated, "repeated-keys")
        return df.join(kept, names).select(*[ref(c) for c in df.columns], F.col(n))
    first_keys = repeated.orderBy(*[ref(k) for k in names]).limit(sample_limit)
    rest = [c for c in df.columns if c not in names]
    return (
        df.join(F.broadcast(first_keys), on=names, how="inner")
        .select(*[ref(c) for c in df.columns], F.col(n))
        .orderBy(*[ref(c).asc_nulls_last() for c in [*names, *rest]])
        .limit(sample_limit)
    )
