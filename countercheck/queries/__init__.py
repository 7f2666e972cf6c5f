"""Every operator as a query over the given tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from countercheck.queries import insights, records, row_diff, shape, values

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    """Query name -> (the Spark query, SQL that has to agree, if there is any)."""
    out: dict[str, tuple[Query, str | None]] = {}
    for module in (row_diff, insights, values, shape, records):
        out.update(module.QUERIES)
    return out
