"""Queries on the row-by-row comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from countercheck.operators.row_diff import RowDiffOptions, row_diff
from countercheck.plans.checks import Check, run_check
from countercheck.queries import derived as D
from countercheck.sinks import storage
from countercheck.sinks.run_table import RunTable

KEY = "o_orderkey"


def _orders_diff(spark, folder):
    return row_diff(D.orders(spark, folder), D.target_orders(spark, folder), [KEY])


def _pairs_sql(columns=D.ORDER_COLUMNS, source="orders", target="target", key=KEY) -> str:
    values = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in columns)
    differ = ", ".join(f"CASE WHEN s.{c} IS DISTINCT FROM t.{c} THEN '{c}' END" for c in columns)
    return f"""pairs AS (
  SELECT coalesce(s.{key}, t.{key}) AS {key}, {values},
         CASE WHEN t.{key} IS NULL THEN 'missing_in_target'
              WHEN s.{key} IS NULL THEN 'extra_in_target'
              WHEN concat_ws(',', {differ}) = '' THEN 'match' ELSE 'mismatch' END AS diff_status,
         concat_ws(',', {differ}) AS differing
  FROM {source} s FULL OUTER JOIN {target} t ON s.{key} = t.{key}
)"""


PAIRS = f"WITH {D.TARGET_ORDERS_SQL}, {_pairs_sql()}"

SUMMARY_SQL = """SELECT
  count(*) FILTER (WHERE diff_status <> 'extra_in_target') AS rows_source,
  count(*) FILTER (WHERE diff_status <> 'missing_in_target') AS rows_target,
  count(*) AS rows_compared,
  count(*) FILTER (WHERE diff_status = 'match') AS rows_matched,
  count(*) FILTER (WHERE diff_status = 'mismatch') AS rows_mismatched,
  count(*) FILTER (WHERE diff_status = 'missing_in_target') AS rows_missing_in_target,
  count(*) FILTER (WHERE diff_status = 'extra_in_target') AS rows_extra_in_target,
  count(*) FILTER (WHERE diff_status <> 'match') AS rows_failed,
  round(count(*) FILTER (WHERE diff_status = 'match') / count(*) * 100.0, 4) AS success_percentage,
  CASE WHEN count(*) FILTER (WHERE diff_status <> 'match') = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM pairs"""


def _one_side_sql(status: str, side: str) -> str:
    values = ", ".join(f"{side}_{c} AS {c}" for c in D.ORDER_COLUMNS)
    return f"{PAIRS} SELECT {KEY}, {values} FROM pairs WHERE diff_status = '{status}'"


def row_diff_summary(spark, folder):
    return _orders_diff(spark, folder).summary()


def row_diff_rows(spark, folder):
    rows = _orders_diff(spark, folder).rows
    return rows.select(
        KEY,
        "diff_status",
        F.when(F.col("diff_status") == "mismatch", F.concat_ws(",", "mismatched")).alias(
            "mismatched_columns"
        ),
    )


ROWS_SQL = f"""{PAIRS} SELECT {KEY}, diff_status,
  CASE WHEN diff_status = 'mismatch' THEN differing END AS mismatched_columns FROM pairs"""


def rows_matched(spark, folder):
    return _orders_diff(spark, folder).matched()


def rows_missing(spark, folder):
    return _orders_diff(spark, folder).missing()


def rows_extra(spark, folder):
    return _orders_diff(spark, folder).extra()


def row_mismatches(spark, folder):
    return _orders_diff(spark, folder).mismatches()


MISMATCHES_SQL = (
    f"{PAIRS} SELECT {KEY}, "
    + ", ".join(f"s_{c} AS {c}_source, t_{c} AS {c}_target" for c in D.ORDER_COLUMNS)
    + ', differing AS "MISMATCHED_COLUMNS" FROM pairs WHERE diff_status = \'mismatch\''
)


def mismatches_by_column(spark, folder):
    return _orders_diff(spark, folder).by_column()


BY_COLUMN_SQL = f"""{PAIRS} SELECT "column", count(*) AS rows FROM (
  SELECT unnest(string_split(differing, ',')) AS "column" FROM pairs WHERE diff_status = 'mismatch'
) GROUP BY 1"""


def row_diff_case(spark, folder):
    """Target names in upper case, the key named in mixed case."""
    target = D.target_orders(spark, folder)
    target = target.select([F.col(c).alias(c.upper()) for c in target.columns])
    return row_diff(D.orders(spark, folder), target, ["O_OrderKey"]).summary()


def _names(spark, folder):
    """Customer names keyed by name, as two systems spell them."""
    source = D.table(spark, folder, "customer").select("c_name", "c_mktsegment", "c_nationkey")
    target = source.select(
        F.concat(F.lit("  "), F.lower("c_name"), F.lit("\t")).alias("c_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" Building "))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("machines"))
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
        "c_nationkey",
    )
    return source, target


def row_diff_normalized(spark, folder):
    source, target = _names(spark, folder)
    options = RowDiffOptions(trim_strings=True, ignore_case=True)
    return row_diff(source, target, ["c_name"], options).mismatches()


NORMALIZED_SQL = """WITH s AS (
  SELECT upper(c_name) AS c_name, upper(c_mktsegment) AS seg, c_nationkey FROM customer
), t AS (
  SELECT upper(c_name) AS c_name,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINES' ELSE upper(c_mktsegment) END AS seg,
         c_nationkey FROM customer
)
SELECT s.c_name, s.seg AS c_mktsegment_source, t.seg AS c_mktsegment_target,
       s.c_nationkey AS c_nationkey_source, t.c_nationkey AS c_nationkey_target,
       'c_mktsegment' AS "MISMATCHED_COLUMNS"
FROM s JOIN t USING (c_name) WHERE s.seg <> t.seg"""


def row_diff_dedup(spark, folder):
    """Lineitem repeats its key. The earliest shipment of a key is kept on
    either side; the target has discounts rounded away."""
    source = D.table(spark, folder, "lineitem")
    target = source.withColumn("l_discount", F.round("l_discount", 1))
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    options = RowDiffOptions(
        on_duplicate_key="keep_first", order_by=order, compare_columns=["l_discount", "l_shipdate"]
    )
    return row_diff(source, target, ["l_orderkey", "l_linenumber"], options).summary()


DEDUP_SQL = f"""WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn
  FROM lineitem
), pairs AS (
  SELECT CASE WHEN l_discount = round(l_discount, 1) THEN 'match' ELSE 'mismatch' END AS diff_status
  FROM ranked WHERE rn = 1
) {SUMMARY_SQL}"""


def row_diff_tolerance(spark, folder):
    """Balances that are off by up to 0.02, compared with a tolerance of 0.01."""
    source = D.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    off = F.when(F.col("c_acctbal") < 0, 0.02).when(F.col("c_acctbal") < 5000, 0.005).otherwise(0.0)
    target = source.withColumn("c_acctbal", F.col("c_acctbal") + off)
    return row_diff(source, target, ["c_custkey"], RowDiffOptions(float_tolerance=0.01)).summary()


TOLERANCE_SQL = f"""WITH pairs AS (
  SELECT CASE WHEN c_acctbal < 0 THEN 'mismatch' ELSE 'match' END AS diff_status FROM customer
) {SUMMARY_SQL}"""


def row_diff_run(spark, folder):
    """The whole check as a recorded run; its summary is read back."""
    runs = RunTable(spark, storage.new_folder(spark, "runs"))
    check = Check(
        "Full Data Validation",
        D.orders(spark, folder),
        D.target_orders(spark, folder),
        {"keys": [KEY]},
    )
    run_check(runs, check)
    fields = (
        "rows_source bigint, rows_target bigint, rows_compared bigint, rows_matched bigint, "
        "rows_mismatched bigint, rows_missing_in_target bigint, rows_extra_in_target bigint, "
        "rows_failed bigint, success_percentage double"
    )
    return runs.runs().select(F.from_json("summary", fields).alias("s"), "status").select("s.*", "status")


QUERIES = {
    "row_diff_summary": (row_diff_summary, f"{PAIRS} {SUMMARY_SQL}"),
    "row_diff": (row_diff_rows, ROWS_SQL),
    "row_diff_case": (row_diff_case, f"{PAIRS} {SUMMARY_SQL}"),
    "row_diff_normalized": (row_diff_normalized, NORMALIZED_SQL),
    "row_diff_dedup": (row_diff_dedup, DEDUP_SQL),
    "row_diff_tolerance": (row_diff_tolerance, TOLERANCE_SQL),
    "rows_matched": (rows_matched, _one_side_sql("match", "s")),
    "rows_missing": (rows_missing, _one_side_sql("missing_in_target", "s")),
    "rows_extra": (rows_extra, _one_side_sql("extra_in_target", "t")),
    "row_mismatches": (row_mismatches, MISMATCHES_SQL),
    "mismatches_by_column": (mismatches_by_column, BY_COLUMN_SQL),
    "row_diff_run": (row_diff_run, f"{PAIRS} {SUMMARY_SQL}"),
}
