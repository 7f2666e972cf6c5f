"""Comparison of table schemas, as rows: one row per table and column.

A catalog is a DataFrame with the columns of ``CATALOG``. It can describe one
table or every table of a database, so one job compares whole catalogs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions import values as V

#: ``declared`` says that length, key and default come from a real catalog, so
#: an empty one means "none"; otherwise they are unknown and not evaluated.
CATALOG = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("native_type", T.StringType()),
        T.StructField("max_length", T.LongType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("default_value", T.StringType()),
        T.StructField("is_primary_key", T.BooleanType()),
        T.StructField("declared", T.BooleanType()),
    ]
)

# Statuses that fail a schema check. A moved column does not.
FAILING = ("MISSING_IN_TARGET", "EXTRA_IN_TARGET", "TYPE_MISMATCH")

SUPPORTED_CHECKS = ("SCHEMA", "RECORD_COUNT", "DUPLICATE", "NULLABILITY")


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog rows from the schemas of DataFrames; no data is read."""
    rows = [
        (table, f.name, i, V.family(f.dataType), f.dataType.simpleString(),
         None, f.nullable, None, None, False)
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG)


def _first_spelling(catalog: DataFrame, side: str) -> DataFrame:
    """One row per folded (table, column): the left-most spelling."""
    fields = [F.col(f.name) for f in CATALOG.fields]
    return (
        catalog.groupBy(
            F.lower("table_name").alias("table_key"), F.lower("column_name").alias("column_key")
        )
        .agg(F.min_by(F.struct(*fields), F.col("position")).alias(side))
    )


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per table and column of either side, source order first."""
    s, t = F.col("s"), F.col("t")
    joined = _first_spelling(source, "s").join(
        _first_spelling(target, "t"), ["table_key", "column_key"], "full_outer"
    )
    status = (
        F.when(t.isNull(), "MISSING_IN_TARGET")
        .when(s.isNull(), "EXTRA_IN_TARGET")
        .when(s["category"] != t["category"], "TYPE_MISMATCH")
        .when(s["position"] != t["position"], "POSITION_MISMATCH")
        .otherwise("MATCH")
    )
    known = F.coalesce(s["declared"] & t["declared"], F.lit(False))

    def same(name: str) -> Column:
        return F.when(known, s[name].eqNullSafe(t[name]))

    # One table has one name, the source's if it has the table; the window sees a table's columns.
    whole = Window.partitionBy("table_key")
    name = F.coalesce(F.min(s["table_name"]).over(whole), F.min(t["table_name"]).over(whole))
    return joined.select(
        name.alias("table_name"),
        F.coalesce(s["column_name"], t["column_name"]).alias("column"),
        s["position"].alias("source_position"),
        t["position"].alias("target_position"),
        s["category"].alias("source_type"),
        t["category"].alias("target_type"),
        status.alias("status"),
        s["max_length"].alias("source_length"),
        t["max_length"].alias("target_length"),
        same("max_length").alias("length_match"),
        s["is_primary_key"].alias("source_key"),
        t["is_primary_key"].alias("target_key"),
        same("is_primary_key").alias("key_match"),
        s["default_value"].alias("source_default"),
        t["default_value"].alias("target_default"),
        same("default_value").alias("default_match"),
    ).orderBy(
        "table_name",
        F.col("source_position").asc_nulls_last(),
        F.col("target_position").asc_nulls_last(),
    )


def schema_summary(diff: DataFrame) -> DataFrame:
    """One row: columns compared, failing columns, failing attributes, verdict."""
    attribute_differs = F.lit(False)
    for name in ("length_match", "key_match", "default_match"):
        attribute_differs = attribute_differs | F.coalesce(~F.col(name), F.lit(False))
    return diff.agg(
        F.count("*").alias("columns_compared"),
        F.count_if(F.col("status").isin(*FAILING)).alias("mismatches"),
        F.count_if(attribute_differs).alias("attribute_mismatches"),
    ).withColumn(
        "status", V.verdict((F.col("mismatches") == 0) & (F.col("attribute_mismatches") == 0))
    )


def plan_checks(
    spark: SparkSession,
    catalog: DataFrame,
    tables: Sequence[str] | None = None,
    modules: Sequence[str] = SUPPORTED_CHECKS,
) -> DataFrame:
    """The checks a catalog suggests, one row per table and module.

    ``check_columns`` are the columns to read, ``key_columns`` the primary key
    (duplicate check) and ``null_check_columns`` those declared NOT NULL. A
    requested table that the catalog lacks gets one row with an ``error``, and
    the rest go on. Names that differ only by case are one table.
    """
    entry = F.struct("position", "column_name")

    def listed(condition: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(condition, entry)))
        return F.transform(ordered, lambda e: e["column_name"])

    per_table = catalog.groupBy(F.lower("table_name").alias("table_key")).agg(
        F.min("table_name").alias("table_name"),
        listed(F.lit(True)).alias("check_columns"),
        listed(F.coalesce("is_primary_key", F.lit(False))).alias("pk"),
        listed(~F.coalesce("nullable", F.lit(True))).alias("not_null"),
    )
    wanted = [m for m in modules if m in SUPPORTED_CHECKS]
    if tables is not None:
        first = {}
        for name in (n.strip() for n in tables):
            if name:
                first.setdefault(name.lower(), name)
        asked = spark.createDataFrame(
            [(k, n) for k, n in first.items()], "table_key string, asked string"
        )
        per_table = asked.join(per_table, "table_key", "left").withColumn(
            "table_name", F.coalesce("table_name", "asked")
        )
    absent = F.col("check_columns").isNull()
    module = F.explode(
        F.when(absent, F.array(F.lit(None).cast("string"))).otherwise(
            F.array(*[F.lit(m) for m in wanted])
        )
    )
    none = F.array().cast("array<string>")
    return (
        per_table.withColumn("module", module)
        .select(
            "table_name",
            "module",
            F.coalesce("check_columns", none).alias("check_columns"),
            F.when(F.col("module") == "DUPLICATE", F.col("pk")).otherwise(none).alias("key_columns"),
            F.when(F.col("module") == "NULLABILITY", F.col("not_null"))
            .otherwise(none)
            .alias("null_check_columns"),
            F.when(absent, F.lit("No catalog metadata for this table.")).alias("error"),
        )
        .orderBy("table_name", "module")
    )
