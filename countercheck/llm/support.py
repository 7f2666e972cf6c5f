"""What the operators of this package share: tables on shared storage, column names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.sinks.storage import clean_shuffles, owned, stored

__all__ = ["clean_shuffles", "owned", "put", "small_batches", "stored", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in small batches, where the session has the default size.

    A batch of the default 10,000 rows of long texts takes hundreds of MB in a worker.
    """
    for key, usual, wanted in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"),
    ):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, wanted)


def put(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns. A column of the input that has the same name, in any case, gives way."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *(column.alias(name) for name, column in columns.items()))
