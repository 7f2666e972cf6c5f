"""Declared table metadata as catalog rows (see operators.schema_diff.CATALOG)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.functions import values as V
from countercheck.operators.integrity import ForeignKey
from countercheck.operators.schema_diff import CATALOG

# Patterns of SQL type names and the family each belongs to,
# tried in this order.
TYPE_PATTERNS = (
    ("bool", V.BOOLEAN),
    ("interval", V.OTHER),
    (r"\b(tiny|small|medium|big)?int(eger|\d+)?\b", V.INTEGER),
    ("serial", V.INTEGER),
    ("float", V.FLOAT),
    ("double", V.FLOAT),
    ("real", V.FLOAT),
    ("numeric", V.FLOAT),
    ("decimal", V.FLOAT),
    ("number", V.FLOAT),
    ("money", V.FLOAT),
    ("date", V.DATETIME),
    ("time", V.DATETIME),
    ("char", V.STRING),
    ("text", V.STRING),
    ("string", V.STRING),
    ("clob", V.STRING),
    ("uuid", V.STRING),
)


def session_table_catalog(spark: SparkSession, table: str) -> DataFrame | None:
    """Catalog rows of a session table; None if there is no such table. Spark
    keeps varchar lengths and defaults, but no primary keys."""
    if not spark.catalog.tableExists(table):
        return None
    rows = []
    for i, f in enumerate(spark.table(table).schema.fields):
        meta = f.metadata or {}
        native = meta.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
        width = re.search(r"\((\d+)\)", native)
        rows.append(
            (
                table,
                f.name,
                i,
                V.family(f.dataType),
                native,
                int(width.group(1)) if width else None,
                f.nullable,
                meta.get("CURRENT_DEFAULT"),
                False,
                True,
            )
        )
    return spark.createDataFrame(rows, CATALOG)


def information_schema_catalog(columns: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Catalog rows from two reads of a database's ``information_schema``:
    ``columns``, and primary-key columns as (table_name, column_name). Both
    can be loaded with a JDBC source."""
    category = F.lit(V.OTHER)
    for pattern, kind in reversed(TYPE_PATTERNS):
        category = F.when(F.lower("data_type").rlike(pattern), kind).otherwise(category)
    keys = key_columns.select("table_name", "column_name").distinct().withColumn("k", F.lit(True))
    out = columns.join(keys, ["table_name", "column_name"], "left")
    return out.select(
        "table_name",
        "column_name",
        (F.col("ordinal_position") - 1).cast("int").alias("position"),
        category.alias("category"),
        F.col("data_type").alias("native_type"),
        F.coalesce("character_maximum_length", "numeric_precision").cast("bigint").alias("max_length"),
        (F.upper("is_nullable") == "YES").alias("nullable"),
        F.col("column_default").cast("string").alias("default_value"),
        F.coalesce("k", F.lit(False)).alias("is_primary_key"),
        F.lit(True).alias("declared"),
    )


def foreign_keys_of(rows: DataFrame) -> list[ForeignKey]:
    """Foreign keys from rows of (constraint_name, table_name, column_name,
    referred_table, referred_column, ordinal_position). One object per declared
    key comes to the driver; an empty list means none are declared."""
    part = F.struct("ordinal_position", "column_name", "referred_column")
    keys = (
        rows.filter(F.col("referred_table").isNotNull())
        .groupBy("constraint_name", "table_name", "referred_table")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .orderBy("table_name", "constraint_name")
    )
    return [
        ForeignKey(
            name=r["constraint_name"],
            table=r["table_name"],
            columns=tuple(p["column_name"] for p in r["parts"]),
            referred_table=r["referred_table"],
            referred_columns=tuple(p["referred_column"] for p in r["parts"]),
        )
        for r in keys.collect()
    ]
