"""Test inputs derived from the given tables.

The given tables have no second copy and few defects, so targets are made from
them by rules on their values, over the whole table. Each rule is written once
for Spark and once as SQL for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countercheck.operators import history as H
from countercheck.operators.schema_diff import CATALOG, catalog_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


ORDER_COLUMNS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")

# A second copy of orders with five faults: the last weeks are missing, some
# prices are in cents, the priority of an early year is in lower case, one
# month lost its customers, and some orders were loaded again under new keys.
TARGET_ORDERS_SQL = """target AS (
  SELECT o_orderkey,
         CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'
              THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
              THEN o_totalprice * 100 ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderdate < TIMESTAMP '1996-01-01'
              THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01'
  UNION ALL
  SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
)"""


def target_orders(spark: SparkSession, folder: str) -> DataFrame:
    source = orders(spark, folder)
    date, status, priority = F.col("o_orderdate"), F.col("o_orderstatus"), F.col("o_orderpriority")

    def day(text: str):
        return F.lit(text).cast("timestamp_ntz")

    kept = source.filter(date < day("2001-07-01")).withColumns(
        {
            "o_custkey": F.when(
                ~((date >= day("1996-01-01")) & (date < day("1996-02-01"))), F.col("o_custkey")
            ),
            "o_totalprice": F.when(
                (status == "P") & (priority == "1-URGENT"), F.col("o_totalprice") * 100
            ).otherwise(F.col("o_totalprice")),
            "o_orderpriority": F.when(date < day("1996-01-01"), F.lower(priority)).otherwise(
                priority
            ),
        }
    )
    again = source.filter((status == "P") & (priority == "5-LOW")).withColumn(
        "o_orderkey", -1 - F.col("o_orderkey")
    )
    return kept.unionByName(again)


# Customers with missing values of every kind.
GAPPY_CUSTOMER_SQL = """gappy AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN '  '
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'N/A' ELSE c_name END AS c_name,
         NULLIF(c_nationkey, 0) AS c_nationkey,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         c_mktsegment
  FROM customer
)"""


def gappy_customer(spark: SparkSession, folder: str) -> DataFrame:
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    return table(spark, folder, "customer").withColumns(
        {
            "c_name": F.when(segment == "BUILDING", F.lit(None))
            .when(segment == "MACHINERY", "  ")
            .when(segment == "AUTOMOBILE", "N/A")
            .otherwise(F.col("c_name")),
            "c_nationkey": F.nullif("c_nationkey", F.lit(0)),
            "c_acctbal": F.when(balance >= 0, balance),
        }
    )


# A run history: one run per event.
RUNS_SQL = """runs AS (
  SELECT 'run-' || CAST(event_id AS VARCHAR) AS run_id,
         CASE event_type WHEN 'click' THEN 'Duplicate Validation'
              WHEN 'view' THEN 'Record Count Validation' WHEN 'error' THEN 'Full Data Validation'
              WHEN 'signup' THEN 'Schema Validation' ELSE 'Referential Integrity' END AS module,
         event_type || ' check' AS name,
         CASE WHEN value < 30 THEN 'PASS' WHEN value < 100 THEN 'FAIL' ELSE 'ERROR' END AS status,
         props AS summary,
         CASE WHEN value < 100 THEN NULL ELSE 'timeout' END AS error,
         value AS runtime_seconds,
         'project-' || CAST(user_id AS VARCHAR) AS project_id,
         'suite-' || CAST(user_id AS VARCHAR) AS suite_id,
         ts AS started_at
  FROM events
)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    none = F.lit(None).cast("string")
    return table(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.when(kind == "click", "Duplicate Validation")
        .when(kind == "view", "Record Count Validation")
        .when(kind == "error", "Full Data Validation")
        .when(kind == "signup", "Schema Validation")
        .otherwise("Referential Integrity")
        .alias("module"),
        F.concat(kind, F.lit(" check")).alias("name"),
        F.when(value < 30, "PASS").when(value < 100, "FAIL").otherwise("ERROR").alias("status"),
        F.col("props").alias("summary"),
        none.alias("source"),
        none.alias("target"),
        F.when(value >= 100, "timeout").alias("error"),
        value.alias("runtime_seconds"),
        F.concat(F.lit("project-"), F.col("user_id").cast("string")).alias("project_id"),
        F.concat(F.lit("suite-"), F.col("user_id").cast("string")).alias("suite_id"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("finished_at"),
    )


# What happened to runs later: slow ones were archived, some of those restored
# a day after, and failed logins (tiny values) deleted.
STATE_SQL = """state_events AS (
  SELECT 'run-' || CAST(event_id AS VARCHAR) AS run_id, 'archive' AS action, ts AS changed_at
  FROM events WHERE value >= 50
  UNION ALL
  SELECT 'run-' || CAST(event_id AS VARCHAR), 'restore', ts + INTERVAL 1 DAY
  FROM events WHERE value >= 50 AND event_type = 'view'
  UNION ALL
  SELECT 'run-' || CAST(event_id AS VARCHAR), 'delete', ts
  FROM events WHERE value < 1
), state AS (
  SELECT run_id, max(CASE WHEN action = 'delete' THEN 1 ELSE 0 END) AS deleted,
         arg_max(action, changed_at) AS latest
  FROM state_events GROUP BY run_id
), current_runs AS (
  SELECT runs.*, coalesce(latest = 'archive', false) AS archived
  FROM runs LEFT JOIN state USING (run_id) WHERE coalesce(deleted, 0) = 0
)"""


def state_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn(
        "run_id", F.concat(F.lit("run-"), F.col("event_id").cast("string"))
    )
    slow = events.filter("value >= 50")
    archived = slow.select("run_id", F.lit(H.ARCHIVE).alias("action"), F.col("ts").alias("at"))
    restored = slow.filter("event_type = 'view'").select(
        "run_id",
        F.lit(H.RESTORE).alias("action"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("at"),
    )
    deleted = events.filter("value < 1").select(
        "run_id", F.lit(H.DELETE).alias("action"), F.col("ts").alias("at")
    )
    return archived.unionByName(restored).unionByName(deleted)


def current_runs(spark: SparkSession, folder: str) -> DataFrame:
    return H.with_state(runs(spark, folder), state_events(spark, folder))


def observed_catalog(
    spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, str]
) -> DataFrame:
    """Catalog rows with what the data shows: the longest text, whether there
    are NULLs, and whether the named column is a key (unique, never NULL). One
    aggregation per table."""
    shape = catalog_of(spark, tables).drop("max_length", "nullable", "is_primary_key", "declared")
    seen = None
    for name, df in tables.items():
        texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
        key = keys.get(name)
        one_row = df.agg(
            F.count("*").alias("n"),
            (F.count_distinct(F.col(key)) if key else F.lit(-1)).alias("distinct_keys"),
            *[F.count(F.col(c)).alias(f"filled{i}") for i, c in enumerate(df.columns)],
            *[
                (F.max(F.length(c)) if c in texts else F.lit(None)).cast("bigint").alias(f"len{i}")
                for i, c in enumerate(df.columns)
            ],
        )
        per_column = one_row.select(
            "n",
            "distinct_keys",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(name).alias("table_name"),
                            F.lit(c).alias("column_name"),
                            F.col(f"len{i}").alias("max_length"),
                            (F.col(f"filled{i}") < F.col("n")).alias("nullable"),
                            (F.lit(c == key) & (F.col("distinct_keys") == F.col("n"))).alias(
                                "is_primary_key"
                            ),
                        )
                        for i, c in enumerate(df.columns)
                    ]
                )
            ).alias("c"),
        ).select("c.*")
        seen = per_column if seen is None else seen.unionByName(per_column)
    full = shape.join(F.broadcast(seen), ["table_name", "column_name"]).withColumn(
        "declared", F.lit(True)
    )
    return full.select(*[f.name for f in CATALOG.fields])


# Customers as a second system might hold them: a column renamed in case, one
# moved and cut, one of another type, one dropped and one added.
OTHER_CUSTOMER_SQL = """other_customer AS (
  SELECT c_custkey, c_acctbal, substr(c_name, 1, 12) AS C_NAME,
         CAST(c_nationkey AS VARCHAR) AS c_nationkey, lower(c_mktsegment) AS segment
  FROM customer
)"""


def other_customer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        "c_acctbal",
        F.substring("c_name", 1, 12).alias("C_NAME"),
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.lower("c_mktsegment").alias("segment"),
    )
