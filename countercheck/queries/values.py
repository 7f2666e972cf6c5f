"""Queries on counts, aggregates, duplicates, completeness and integrity."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countercheck.operators import aggregates, completeness, counts, duplicates, integrity
from countercheck.operators.aggregates import Metric
from countercheck.queries import derived as D
from countercheck.sources.catalog import foreign_keys_of

TARGET = f"WITH {D.TARGET_ORDERS_SQL}"
GAPPY = f"WITH {D.GAPPY_CUSTOMER_SQL}"


def record_count(spark, folder):
    return counts.record_count(
        D.orders(spark, folder), D.target_orders(spark, folder), tolerance_percent=5.0
    )


RECORD_COUNT_SQL = f"""{TARGET}, n AS (
  SELECT (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM target) AS target_count
)
SELECT source_count, target_count, target_count - source_count AS difference,
       round(abs(target_count - source_count) / source_count * 100.0, 4) AS variance_percent,
       CASE WHEN abs(target_count - source_count) / source_count * 100.0 <= 5.0
            THEN 'PASS' ELSE 'FAIL' END AS status
FROM n"""


def record_count_grouped(spark, folder):
    """Groups with a missing part do not meet: nation 0 is NULL on both sides."""
    source = D.gappy_customer(spark, folder)
    target = source.filter("c_mktsegment <> 'HOUSEHOLD' OR c_acctbal IS NOT NULL")
    return counts.record_count_by_group(source, target, ["c_nationkey", "c_mktsegment"])


RECORD_COUNT_GROUPED_SQL = f"""{GAPPY}, s AS (
  SELECT c_nationkey, c_mktsegment, count(*) AS source_count FROM gappy GROUP BY ALL
), t AS (
  SELECT c_nationkey, c_mktsegment, count(*) AS target_count FROM gappy
  WHERE c_mktsegment <> 'HOUSEHOLD' OR c_acctbal IS NOT NULL GROUP BY ALL
), j AS (
  SELECT coalesce(s.c_nationkey, t.c_nationkey) AS c_nationkey,
         coalesce(s.c_mktsegment, t.c_mktsegment) AS c_mktsegment,
         coalesce(source_count, 0) AS source_count, coalesce(target_count, 0) AS target_count
  FROM s FULL OUTER JOIN t ON s.c_nationkey = t.c_nationkey AND s.c_mktsegment = t.c_mktsegment
)
SELECT *, target_count - source_count AS difference,
       CASE WHEN source_count = 0 THEN CASE WHEN target_count = 0 THEN 0.0 ELSE 100.0 END
            ELSE round(abs(target_count - source_count) / source_count * 100.0, 4) END AS variance_percent
FROM j"""

METRICS = [
    Metric("o_custkey", "COUNT"),
    Metric("o_custkey", "COUNT_DISTINCT"),
    Metric("o_totalprice", "SUM"),
    Metric("o_totalprice", "AVG", "mean_price"),
    Metric("o_totalprice", "MIN"),
    Metric("o_totalprice", "MAX"),
]


def _rounded(comparison):
    return comparison.withColumns(
        {c: F.round(c, 2) for c in ("source_value", "target_value", "difference", "variance_percent")}
    )


def agg_compare(spark, folder):
    return _rounded(
        aggregates.aggregate_compare(
            D.orders(spark, folder), D.target_orders(spark, folder), METRICS, tolerance_percent=1.0
        )
    )


def agg_compare_grouped(spark, folder):
    return _rounded(
        aggregates.aggregate_compare(
            D.orders(spark, folder),
            D.target_orders(spark, folder),
            METRICS,
            ["O_ORDERPRIORITY"],
            tolerance_percent=1.0,
        )
    )


def agg_compare_self(spark, folder):
    """The same rows in another order and other partitions differ in nothing, at tolerance 0."""
    orders = D.orders(spark, folder)
    moved = orders.repartition(7, "o_custkey")
    same = aggregates.aggregate_compare(orders, moved, METRICS, ["o_orderstatus"])
    return same.select("o_orderstatus", "metric", "difference", "status")


AGG_SELF_SQL = f"""SELECT o_orderstatus, unnest([{', '.join(repr(m.name) for m in METRICS)}]) AS metric,
  CAST(0 AS DOUBLE) AS difference, 'PASS' AS status FROM (SELECT DISTINCT o_orderstatus FROM orders)"""
LARGE = 9007199254740993


def agg_exact(spark, folder):
    """Whole numbers beyond 2**53 that differ by one in one row."""
    key = F.col("o_orderkey").cast("bigint")
    source = D.orders(spark, folder).select((key + LARGE).alias("v"))
    last = D.orders(spark, folder).agg(F.max("o_orderkey").alias("last"))
    target = D.orders(spark, folder).crossJoin(F.broadcast(last))
    target = target.select((key + LARGE - (key == F.col("last")).cast("bigint")).alias("v"))
    wanted = [aggregates.Metric("v", f) for f in ("SUM", "MAX", "MIN", "COUNT")]
    return aggregates.aggregate_compare(source, target, wanted).select("metric", "difference", "status")


AGG_EXACT_SQL = """SELECT * FROM (VALUES ('SUM_v', CAST(-1 AS DOUBLE), 'FAIL'), ('MAX_v', CAST(-1 AS DOUBLE), 'FAIL'),
  ('MIN_v', CAST(0 AS DOUBLE), 'PASS'), ('COUNT_v', CAST(0 AS DOUBLE), 'PASS')) t(metric, difference, status)"""


def agg_float_exact(spark, folder):
    """Floats of the orders beside a very large one: a hundred more in one row is a difference, another order is none."""
    price = F.col("o_totalprice").cast("double")
    source = D.orders(spark, folder).select("o_orderkey", price.alias("v"))
    large = source.select("o_orderkey", F.when(F.col("o_orderkey") == 1, F.lit(1e15)).otherwise(F.lit(0.0)).alias("v"))
    first = F.when(F.col("o_orderkey") == 1, F.col("v") + 100).otherwise(F.col("v"))
    sides = {"moved": source.repartition(5, "v"), "raised": source.withColumn("v", first)}
    sides |= {"large moved": large.repartition(3), "large raised": large.withColumn("v", first)}
    out = []
    for name, target in sides.items():
        wanted = [aggregates.Metric("v", f) for f in ("SUM", "AVG")]
        found = aggregates.aggregate_compare(large if "large" in name else source, target, wanted)
        out.append(found.select(F.lit(name).alias("target"), "metric", F.round("difference", 1).alias("difference"), "status"))
    return functools.reduce(DataFrame.unionByName, out)


AGG_FLOAT_EXACT_SQL = """WITH n AS (SELECT count(*) AS n FROM orders),
d(target, raised) AS (VALUES ('moved', 0.0), ('raised', 100.0), ('large moved', 0.0), ('large raised', 100.0))
SELECT target, 'SUM_v' AS metric, CAST(raised AS DOUBLE) AS difference, CASE WHEN raised = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM d
UNION ALL
SELECT target, 'AVG_v', round(CAST(raised AS DOUBLE) / n, 1), CASE WHEN raised = 0 THEN 'PASS' ELSE 'FAIL' END FROM d, n"""


def agg_summary(spark, folder):
    return aggregates.aggregate_summary(agg_compare_grouped(spark, folder))


def _aggregate_sql(group: str | None) -> str:
    group_list = f"{group}, " if group else ""
    expressions = {
        "COUNT_o_custkey": "count(o_custkey)",
        "COUNT_DISTINCT_o_custkey": "count(DISTINCT o_custkey)",
        "SUM_o_totalprice": "sum(o_totalprice)",
        "mean_price": "avg(o_totalprice)",
        "MIN_o_totalprice": "min(o_totalprice)",
        "MAX_o_totalprice": "max(o_totalprice)",
    }

    def side(name: str, value: str) -> str:
        parts = [
            f"SELECT {group_list}'{metric}' AS metric, CAST({e} AS DOUBLE) AS {value} FROM {name}"
            + (f" GROUP BY {group}" if group else "")
            for metric, e in expressions.items()
        ]
        return " UNION ALL ".join(parts)

    keys = f"{group}, metric" if group else "metric"
    return f"""{TARGET}, s AS ({side("orders", "sv")}), t AS ({side("target", "tv")}), j AS (
  SELECT {keys}, coalesce(sv, 0) AS sv, coalesce(tv, 0) AS tv FROM s FULL OUTER JOIN t USING ({keys})
), v AS (
  SELECT *, CASE WHEN sv = 0 THEN CASE WHEN tv = 0 THEN 0.0 ELSE 100.0 END
                 ELSE abs(tv - sv) / abs(sv) * 100.0 END AS variance FROM j
)
SELECT {group_list}metric, round(sv, 2) AS source_value, round(tv, 2) AS target_value,
       round(tv - sv, 2) AS difference, round(variance, 2) AS variance_percent,
       CASE WHEN variance <= 1.0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM v"""


AGG_SUMMARY_SQL = f"""SELECT count(DISTINCT metric) AS metrics_compared, count(*) AS rows_compared,
  count(*) FILTER (WHERE status = 'FAIL') AS rows_failed,
  CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM ({_aggregate_sql("o_orderpriority")})"""

LINE_KEY = ["l_orderkey", "l_linenumber"]


def dup_groups(spark, folder):
    return duplicates.duplicate_groups(D.table(spark, folder, "lineitem"), LINE_KEY)


def dup_summary(spark, folder):
    return duplicates.duplicate_summary(D.table(spark, folder, "lineitem"), LINE_KEY)


def dup_rows(spark, folder):
    return duplicates.duplicate_rows(D.table(spark, folder, "lineitem"), LINE_KEY, 1000)


def dup_texts(spark, folder):
    """All rows whose whole text occurs more than once; no limit."""
    rows = duplicates.duplicate_rows(D.table(spark, folder, "documents"), ["text"], None)
    return rows.select("doc_id", "text", "occurrence_count")


LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)


def null_stats(spark, folder):
    return completeness.null_stats(D.gappy_customer(spark, folder)).drop("total_rows")


def null_score(spark, folder):
    return completeness.null_score(completeness.null_stats(D.gappy_customer(spark, folder)), 80.0)


def _null_stats_sql() -> str:
    listed = ", ".join(f"'{s}'" for s in completeness.SENTINELS)
    blocks = [
        f"""SELECT '{c}' AS "column", count(*) AS total_rows,
  count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') AS blank_count,
  count(*) FILTER (WHERE CAST({c} AS VARCHAR) IN ({listed})) AS sentinel_count FROM gappy"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ]
    return f"{GAPPY}, stats AS ({' UNION ALL '.join(blocks)})"


NULL_STATS_SQL = f"""{_null_stats_sql()}
SELECT "column", null_count, blank_count, sentinel_count,
       null_count + blank_count + sentinel_count AS missing_count,
       round((total_rows - null_count - blank_count - sentinel_count) / total_rows * 100.0, 4)
         AS completeness_percent
FROM stats"""

NULL_SCORE_SQL = f"""{_null_stats_sql()}, score AS (
  SELECT max(total_rows) AS total_rows,
         avg((total_rows - null_count - blank_count - sentinel_count) / total_rows * 100.0) AS s FROM stats
)
SELECT total_rows, round(s, 4) AS completeness_score,
       CASE WHEN s >= 80.0 THEN 'PASS' ELSE 'FAIL' END AS status FROM score"""


def _integrity_sides(spark, folder):
    """Orders of which some lost their customer key, and customers of which a
    whole segment is gone."""
    child = D.orders(spark, folder).withColumn(
        "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    )
    parent = D.table(spark, folder, "customer").filter("c_mktsegment <> 'BUILDING'")
    return child, parent, ["o_custkey"], ["c_custkey"]


INTEGRITY_SQL = """WITH child AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey,
         o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
), parent AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'),
flagged AS (
  SELECT *, o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM parent) AS orphan FROM child
)"""


def orphans(spark, folder):
    return integrity.orphans(*_integrity_sides(spark, folder), sample_limit=None)


def orphan_sample(spark, folder):
    return integrity.orphans(*_integrity_sides(spark, folder), sample_limit=1000)


def orphan_summary(spark, folder):
    return integrity.orphan_summary(*_integrity_sides(spark, folder), tolerance_percent=25.0)


def _orphan_summary_sql(tolerance: float, keys: str, present: str) -> str:
    return f"""SELECT count(*) AS child_rows, count(*) FILTER (WHERE {present}) AS checked_rows,
  count(*) FILTER (WHERE NOT ({present})) AS null_key_rows,
  count(*) FILTER (WHERE orphan) AS orphan_rows,
  round(coalesce(count(*) FILTER (WHERE orphan) / nullif(count(*) FILTER (WHERE {present}), 0), 0) * 100.0, 4)
    AS orphan_percent,
  count(DISTINCT CASE WHEN orphan THEN {keys} END) AS distinct_orphan_keys,
  CASE WHEN coalesce(count(*) FILTER (WHERE orphan) / nullif(count(*) FILTER (WHERE {present}), 0), 0)
       * 100.0 <= {tolerance} THEN 'PASS' ELSE 'FAIL' END AS status
FROM flagged"""


def orphan_composite(spark, folder):
    """Shipped lines whose part and supplier never appear on a returned line."""
    lines = D.table(spark, folder, "lineitem")
    key = ["l_partkey", "l_suppkey"]
    return integrity.orphan_summary(
        lines.filter("l_returnflag <> 'R'"), lines.filter("l_returnflag = 'R'"), key, key
    )


COMPOSITE_SQL = f"""WITH parent AS (
  SELECT DISTINCT l_partkey, l_suppkey, true AS found FROM lineitem WHERE l_returnflag = 'R'
), flagged AS (
  SELECT l.l_partkey, l.l_suppkey, found IS NULL AS orphan
  FROM lineitem l LEFT JOIN parent USING (l_partkey, l_suppkey) WHERE l_returnflag <> 'R'
) {_orphan_summary_sql(0.0, "(l_partkey, l_suppkey)", "l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")}"""

FOREIGN_KEYS = [
    integrity.ForeignKey(f"{child}_{parent}", child, (c,), parent, (p,))
    for child, c, parent, p in (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("documents", "doc_id", "labels", "doc_id"),
    )
]


def fk_sweep(spark, folder):
    names = {n for fk in FOREIGN_KEYS for n in (fk.table, fk.referred_table)}
    tables = {n: D.table(spark, folder, n) for n in names}
    return integrity.foreign_key_sweep(tables, FOREIGN_KEYS)


def fk_declared(spark, folder):
    """The keys as a catalog declares them, those of tables that are not given left out."""
    rows = [
        (fk.name, fk.table, c, fk.referred_table, r, i)
        for fk in FOREIGN_KEYS
        for i, (c, r) in enumerate(zip(fk.columns, fk.referred_columns, strict=True), 1)
    ]
    kind = "constraint_name string, table_name string, column_name string, referred_table string, referred_column string, ordinal_position int"
    declared = foreign_keys_of(spark.createDataFrame(rows, kind))
    tables = {n: D.table(spark, folder, n) for fk in FOREIGN_KEYS for n in (fk.table, fk.referred_table)}
    return integrity.sweep_summary(integrity.foreign_key_sweep(tables, declared))


def _fk_sql(fk: integrity.ForeignKey) -> str:
    c, p = fk.columns[0], fk.referred_columns[0]
    flagged = f"""(SELECT {c} AS k, {c} IS NOT NULL AND {c} NOT IN (SELECT {p} FROM {fk.referred_table})
  AS orphan FROM {fk.table}) flagged"""
    body = _orphan_summary_sql(0.0, "k", "k IS NOT NULL").replace("FROM flagged", f"FROM {flagged}")
    head = f"SELECT '{fk.name}' AS foreign_key, '{fk.table}' AS child_table, '{fk.referred_table}' AS parent_table, "
    return body.replace("SELECT ", head, 1)


QUERIES = {
    "record_count": (record_count, RECORD_COUNT_SQL),
    "record_count_grouped": (record_count_grouped, RECORD_COUNT_GROUPED_SQL),
    "agg_compare": (agg_compare, _aggregate_sql(None)),
    "agg_compare_grouped": (agg_compare_grouped, _aggregate_sql("o_orderpriority")),
    "agg_summary": (agg_summary, AGG_SUMMARY_SQL),
    "agg_compare_self": (agg_compare_self, AGG_SELF_SQL),
    "agg_exact": (agg_exact, AGG_EXACT_SQL),
    "agg_float_exact": (agg_float_exact, AGG_FLOAT_EXACT_SQL),
    "dup_groups": (
        dup_groups,
        "SELECT l_orderkey, l_linenumber, count(*) AS occurrence_count FROM lineitem "
        "GROUP BY ALL HAVING count(*) > 1",
    ),
    "dup_summary": (
        dup_summary,
        """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (WHERE n > 1) AS duplicate_key_count,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_row_count,
       round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n) * 100.0, 4) AS duplicate_percent,
       CASE WHEN count(*) FILTER (WHERE n > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""",
    ),
    "dup_rows": (
        dup_rows,
        f"""WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS occurrence_count FROM lineitem
  GROUP BY ALL HAVING count(*) > 1)
SELECT {LINE_COLUMNS}, occurrence_count FROM lineitem JOIN g USING (l_orderkey, l_linenumber)
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 1000""",
    ),
    "dup_texts": (
        dup_texts,
        """SELECT doc_id, text, occurrence_count FROM documents JOIN (
  SELECT text, count(*) AS occurrence_count FROM documents GROUP BY text HAVING count(*) > 1
) USING (text)""",
    ),
    "null_stats": (null_stats, NULL_STATS_SQL),
    "null_score": (null_score, NULL_SCORE_SQL),
    "orphans": (
        orphans,
        f"{INTEGRITY_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
        "o_orderpriority FROM flagged WHERE orphan",
    ),
    "orphan_sample": (
        orphan_sample,
        f"{INTEGRITY_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
        "o_orderpriority FROM flagged WHERE orphan ORDER BY o_custkey, o_orderkey LIMIT 1000",
    ),
    "orphan_summary": (
        orphan_summary,
        f"{INTEGRITY_SQL} {_orphan_summary_sql(25.0, 'o_custkey', 'o_custkey IS NOT NULL')}",
    ),
    "orphan_composite": (orphan_composite, COMPOSITE_SQL),
    "fk_sweep": (fk_sweep, " UNION ALL ".join(_fk_sql(fk) for fk in FOREIGN_KEYS)),
    "fk_declared": (
        fk_declared,
        f"""SELECT count(*) AS foreign_keys_checked, count(*) FILTER (WHERE status = 'FAIL') AS foreign_keys_failed,
  CAST(sum(checked_rows) AS BIGINT) AS checked_rows, CAST(sum(orphan_rows) AS BIGINT) AS orphan_rows,
  CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM ({" UNION ALL ".join(_fk_sql(fk) for fk in FOREIGN_KEYS)})""",
    ),
}
