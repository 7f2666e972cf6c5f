"""Queries on what mismatches have in common: one fault per query, found on
every row of a table, and all findings of the faulty orders together."""

from __future__ import annotations

from pyspark.sql import functions as F

from countercheck.operators import insights as I
from countercheck.operators.row_diff import row_diff
from countercheck.queries import derived as D
from countercheck.queries.row_diff import PAIRS

SHOWN = ("kind", "column", "affected_rows", "coverage")


def _finding(table: str, key: str, column: str, fault):
    """Compare a table with a copy that has one faulty column."""

    def query(spark, folder):
        source = D.table(spark, folder, table).select(key, column)
        diff = row_diff(source, source.withColumn(column, fault(F.col(column))), [key])
        evidence = I.column_evidence(I.mismatched_cells(diff))
        return I.explain_columns(evidence).select(*SHOWN)

    return query


def _finding_sql(table: str, column: str, fault: str, kind: str, holds: str) -> str:
    """The same from scratch: ``holds`` is the rule, over pairs s and t."""
    return f"""WITH pairs AS (
  SELECT {column} AS s, {fault} AS t FROM {table}
), differing AS (SELECT * FROM pairs WHERE s IS DISTINCT FROM t)
SELECT '{kind}' AS kind, '{column}' AS "column", count(*) AS affected_rows,
       CAST(1.0 AS DOUBLE) AS coverage
FROM differing HAVING count(*) > 0 AND {holds}"""


def insight_null(spark, folder):
    return _finding("customer", "c_custkey", "c_name", lambda c: F.lit(None).cast("string"))(spark, folder)


def insight_null_source(spark, folder):
    """Values that only the target has."""
    target = D.table(spark, folder, "customer").select("c_custkey", "c_name")
    source = target.withColumn("c_name", F.lit(None).cast("string"))
    diff = row_diff(source, target, ["c_custkey"])
    return I.explain_columns(I.column_evidence(I.mismatched_cells(diff))).select(*SHOWN)


def insight_hits(spark, folder):
    """Differing rows per column, with their share of all differing rows."""
    diff = row_diff(D.orders(spark, folder), D.target_orders(spark, folder), ["o_orderkey"])
    evidence = I.column_evidence(I.mismatched_cells(diff))
    return evidence.select("column", "hits", "total_rows", F.round("coverage", 6).alias("coverage"))


HITS_SQL = f"""{PAIRS}, listed AS (
  SELECT unnest(string_split(differing, ',')) AS "column" FROM pairs WHERE diff_status = 'mismatch'
), total AS (SELECT count(*) AS n FROM pairs WHERE diff_status = 'mismatch')
SELECT "column", count(*) AS hits, any_value(n) AS total_rows,
       round(count(*) / any_value(n), 6) AS coverage
FROM listed, total GROUP BY 1"""


def insight_ranked(spark, folder):
    diff = row_diff(D.orders(spark, folder), D.target_orders(spark, folder), ["o_orderkey"])
    found = I.findings(I.mismatched_cells(diff))
    return found.select(
        F.col("place").cast("bigint").alias("place"),
        "kind",
        "column",
        "affected_rows",
        F.round("coverage", 6).alias("coverage"),
        F.round("measure", 6).alias("measure"),
    )


RANKED_SQL = f"""{PAIRS}, bad AS (SELECT * FROM pairs WHERE diff_status = 'mismatch'),
hits AS (
  SELECT 'o_custkey' AS "column", count(*) AS n FROM bad WHERE s_o_custkey IS DISTINCT FROM t_o_custkey
  UNION ALL SELECT 'o_totalprice', count(*) FROM bad WHERE s_o_totalprice IS DISTINCT FROM t_o_totalprice
  UNION ALL SELECT 'o_orderpriority', count(*) FROM bad WHERE s_o_orderpriority IS DISTINCT FROM t_o_orderpriority
), causes AS (
  SELECT 'null-on-target' AS kind, 'o_custkey' AS "column", CAST(NULL AS DOUBLE) AS measure FROM bad
    WHERE s_o_custkey IS DISTINCT FROM t_o_custkey HAVING count(t_o_custkey) = 0 AND count(s_o_custkey) > 0
  UNION ALL SELECT 'constant-ratio', 'o_totalprice', round(median(t_o_totalprice / s_o_totalprice), 6) FROM bad
    WHERE s_o_totalprice <> t_o_totalprice
    HAVING count(*) >= 3 AND max(abs(t_o_totalprice / s_o_totalprice - 100)) <= 1e-8 + 1e-7
  UNION ALL SELECT 'case-only', 'o_orderpriority', NULL FROM bad
    WHERE s_o_orderpriority <> t_o_orderpriority HAVING bool_and(lower(s_o_orderpriority) = lower(t_o_orderpriority))
), top AS (
  SELECT "column", n, (SELECT count(*) FROM hits WHERE n > 0) AS columns FROM hits WHERE n > 0
  ORDER BY n DESC, "column" LIMIT 1
), found AS (
  SELECT kind, "column", n AS affected_rows, measure, 0 AS late FROM causes JOIN hits USING ("column")
  UNION ALL SELECT 'column-concentration', "column", n, columns, 1 FROM top
    WHERE columns = 1 OR n >= 0.5 * (SELECT count(*) FROM bad)
)
SELECT row_number() OVER (ORDER BY affected_rows DESC, late, "column") AS place, kind, "column",
       affected_rows, round(affected_rows / (SELECT count(*) FROM bad), 6) AS coverage, measure
FROM found"""


def insight_key_block(spark, folder):
    """A load that stopped half way: all keys above the mean are missing."""
    source = D.orders(spark, folder)
    mean = source.agg(F.avg("o_orderkey")).first()[0]
    target = source.filter(F.col("o_orderkey") <= mean)
    missing = row_diff(source, target, ["o_orderkey"]).missing()
    found = I.key_block(missing, ["o_orderkey"], "missing")
    return found.select("kind", "side", "column", "affected_rows", "low", "high")


KEY_BLOCK_SQL = """WITH missing AS (
  SELECT o_orderkey AS k FROM orders WHERE o_orderkey > (SELECT avg(o_orderkey) FROM orders)
)
SELECT 'contiguous-key-block' AS kind, 'missing' AS side, 'o_orderkey' AS "column",
       count(*) AS affected_rows, min(k) AS low, max(k) AS high
FROM missing HAVING count(*) >= 3 AND count(DISTINCT k) = count(*) AND max(k) - min(k) + 1 = count(*)"""


def _constant(expression: str, test: str) -> str:
    return f"count(*) >= 3 AND max({expression}) - min({expression}) <= {test}"


QUERIES = {
    "insight_hits": (insight_hits, HITS_SQL),
    "insight_null_source": (
        insight_null_source,
        """SELECT 'null-on-source' AS kind, 'c_name' AS "column", count(*) AS affected_rows,
       CAST(1.0 AS DOUBLE) AS coverage FROM customer WHERE c_name IS NOT NULL""",
    ),
    "insight_null": (
        insight_null,
        _finding_sql(
            "customer", "c_name", "CAST(NULL AS VARCHAR)", "null-on-target",
            "count(t) = 0 AND count(s) > 0",
        ),
    ),
    "insight_whitespace": (
        _finding("customer", "c_custkey", "c_name", lambda c: F.concat(c, F.lit("  "))),
        _finding_sql(
            "customer", "c_name", "c_name || '  '", "whitespace-only", "bool_and(trim(s) = trim(t))"
        ),
    ),
    "insight_case": (
        _finding("customer", "c_custkey", "c_name", F.upper),
        _finding_sql("customer", "c_name", "upper(c_name)", "case-only", "bool_and(lower(s) = lower(t))"),
    ),
    "insight_truncation": (
        _finding("documents", "doc_id", "text", lambda c: F.substring(c, 1, 8)),
        _finding_sql(
            "documents", "text", "substr(text, 1, 8)", "truncation",
            "count(*) >= 3 AND bool_and(starts_with(s, t) AND length(t) < length(s))",
        ),
    ),
    "insight_ratio": (
        _finding("orders", "o_orderkey", "o_totalprice", lambda c: c * 100),
        _finding_sql(
            "orders", "o_totalprice", "o_totalprice * 100", "constant-ratio", _constant("t / s", "2e-7")
        ),
    ),
    "insight_sign_flip": (
        _finding("orders", "o_orderkey", "o_totalprice", lambda c: -c),
        _finding_sql(
            "orders", "o_totalprice", "-o_totalprice", "sign-flip",
            "count(*) >= 3 AND max(abs(t / s + 1)) < 1e-9",
        ),
    ),
    "insight_offset": (
        _finding("orders", "o_orderkey", "o_totalprice", lambda c: c + 7),
        _finding_sql(
            "orders", "o_totalprice", "o_totalprice + 7", "constant-offset", _constant("t - s", "1.4e-8")
        ),
    ),
    "insight_rounding": (
        _finding("orders", "o_orderkey", "o_totalprice", lambda c: F.floor(c).cast("double") + F.round(c - F.floor(c), 1)),
        _finding_sql(
            "orders", "o_totalprice", "floor(o_totalprice) + round(o_totalprice - floor(o_totalprice), 1)",
            "rounding",
            "count(*) >= 3 AND max(abs(t - s)) <= 0.5 AND max(abs(t - s)) / max(abs(s)) <= 1e-4",
        ),
    ),
    "insight_time_shift": (
        _finding("orders", "o_orderkey", "o_orderdate", lambda c: c + F.expr("INTERVAL 5 HOUR")),
        _finding_sql(
            "orders", "o_orderdate", "o_orderdate + INTERVAL 5 HOUR", "time-shift",
            "count(*) >= 3 AND min(t - s) = max(t - s)",
        ),
    ),
    "insight_key_block": (insight_key_block, KEY_BLOCK_SQL),
    "insight_ranked": (insight_ranked, RANKED_SQL),
}
