"""Queries on run history, suites and what is written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from countercheck.operators import history as H
from countercheck.operators.row_diff import row_diff
from countercheck.plans.suites import Suite, outcomes_frame, run_suites
from countercheck.queries import derived as D
from countercheck.queries.row_diff import PAIRS
from countercheck.sinks import reports, storage
from countercheck.sinks.details import DetailStore
from countercheck.sinks.run_table import RunTable

CURRENT = f"WITH {D.RUNS_SQL}, {D.STATE_SQL}"
SHOWN = ("run_id", "module", "name", "status", "runtime_seconds", "started_at")


def run_state(spark, folder):
    return D.current_runs(spark, folder).select("run_id", "module", "status", "archived")


def run_history(spark, folder):
    """The newest 200 runs of one module that are not archived."""
    return H.run_history(D.current_runs(spark, folder), module="Duplicate Validation", limit=200).select(*SHOWN)


def run_totals(spark, folder):
    return H.run_totals(_all(spark, folder))


def _project(title):
    def query(spark, folder):
        return H.project_report(_all(spark, folder), "demo")[title]

    return query


def _all(spark, folder):
    return D.current_runs(spark, folder).filter(~F.col("archived"))


def pass_rate_by_day(spark, folder):
    return H.pass_rate_by_day(_all(spark, folder))


def runs_by_module(spark, folder):
    return H.runs_by_module(_all(spark, folder))


def runtime_trend(spark, folder):
    return H.runtime_trend(_all(spark, folder))


COUNTS = """count(*) FILTER (WHERE status = 'PASS') AS passed,
  count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'ERROR') AS errored"""
CURRENTLY = "(SELECT * FROM current_runs WHERE NOT archived)"
TOTALS = f"""count(*) AS total_runs, {COUNTS},
  round(count(*) FILTER (WHERE status = 'PASS') / count(*) * 100.0, 2) AS pass_rate_percent FROM {CURRENTLY}"""

# One suite per customer; its last run is the latest event of that user.
SEGMENT_MODULES = {
    "BUILDING": "Duplicate Validation",
    "MACHINERY": "Record Count Validation",
    "AUTOMOBILE": "Full Data Validation",
    "FURNITURE": "Schema Validation",
    "HOUSEHOLD": "Referential Integrity",
}


def _suites(spark, folder):
    module = F.lit(None).cast("string")
    for segment, name in SEGMENT_MODULES.items():
        module = F.when(F.col("c_mktsegment") == segment, name).otherwise(module)
    customers = D.table(spark, folder, "customer").select(
        F.concat(F.lit("suite-"), F.col("c_custkey").cast("string")).alias("suite_id"),
        F.col("c_name").alias("name"),
        module.alias("module"),
    )
    return H.with_last_run(customers, D.runs(spark, folder))


def _suites_sql() -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in SEGMENT_MODULES.items())
    return f"""WITH {D.RUNS_SQL}, last AS (
  SELECT suite_id, arg_max(run_id, started_at) AS run_id, max(started_at) AS last_at FROM runs GROUP BY suite_id
), suites AS (
  SELECT c_name AS name, CASE c_mktsegment {cases} END AS module, run_id AS last_run_id, last_at AS last_run_at
  FROM customer LEFT JOIN last ON suite_id = 'suite-' || CAST(c_custkey AS VARCHAR)
)"""


def suite_report(spark, folder):
    return H.suite_report(
        _suites(spark, folder), D.runs(spark, folder), "Duplicate Validation", metrics=["k"]
    )


def suite_totals(spark, folder):
    return H.suite_totals(_suites(spark, folder))


def batch_ranges(spark, folder):
    return reports.batch_ranges(D.table(spark, folder, "lineitem"), "LINEITEM", 7000)


def numbered_rows(spark, folder):
    """Events numbered in order of type and time, with their batch."""
    events = D.table(spark, folder, "events").select("event_type", "ts", "event_id")
    numbered = reports.number_rows(events, ["event_type", "ts", "event_id"])
    return numbered.withColumn("batch", reports.batch_number(F.col("row_number"), 3000))


def batch_files(spark, folder):
    """Orders written in batches and read back: rows and keys per batch."""
    path = storage.new_folder(spark, "batches")
    reports.write_batches(D.orders(spark, folder), path, "ORDERS", ["o_orderdate", "o_orderkey"], 4000)
    back = spark.read.option("header", "true").csv(path)
    key = F.col("o_orderkey").cast("bigint")
    return back.groupBy(F.col("batch").cast("bigint").alias("batch")).agg(
        F.count("*").alias("rows"),
        F.count_distinct("o_orderkey").alias("keys"),
        F.sum(key).alias("key_sum"),
        F.min("o_orderdate").cast("timestamp_ntz").alias("first_date"),
    )


BATCH_FILES_SQL = """WITH n AS (
  SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
)
SELECT CAST((rn - 1) // 4000 + 1 AS BIGINT) AS batch, count(*) AS rows,
       count(DISTINCT o_orderkey) AS keys, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       CAST(min(o_orderdate) AS TIMESTAMP) AS first_date
FROM n GROUP BY 1"""


def csv_report(spark, folder):
    """Row differences written as a CSV report and read back by section."""
    diff = row_diff(D.orders(spark, folder), D.target_orders(spark, folder), ["o_orderkey"])
    sections = {"Missing in Target": diff.missing(), "Extra in Target": diff.extra()}
    path = storage.new_folder(spark, "csv-report")
    written = reports.write_csv_report(spark, path, {"module": "Full Data Validation"}, sections)
    return _section_counts({t: spark.read.csv(written[t], header=True) for t in sections})


def json_report(spark, folder):
    diff = row_diff(D.orders(spark, folder), D.target_orders(spark, folder), ["o_orderkey"])
    sections = {"Missing in Target": diff.missing(), "Extra in Target": diff.extra()}
    path = storage.new_folder(spark, "json-report")
    written = reports.write_json_report(spark, path, "Orders", {}, sections)
    return _section_counts({t: spark.read.json(written[t]) for t in sections})


TITLES = ("A B", "A/B", "\u5dee\u5f02", "\u7f3a\u5931", "Summary", "report")


def report_titles(spark, folder):
    """Sections whose titles are alike or mean something else to a file system, read back."""
    orders = D.orders(spark, folder)
    status = F.pmod(F.col("o_orderkey"), F.lit(len(TITLES)))
    sections = {t: orders.filter(status == i) for i, t in enumerate(TITLES)}
    path = storage.new_folder(spark, "titles")
    written = reports.write_csv_report(spark, path, {}, sections)
    return _section_counts({t: spark.read.csv(written[t], header=True) for t in sections})


REPORT_TITLES_SQL = f"""SELECT list_value{TITLES}[CAST(o_orderkey % {len(TITLES)} AS INT) + 1] AS section, count(*) AS rows,
  CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1"""


def detail_roundtrip(spark, folder):
    diff = row_diff(D.orders(spark, folder), D.target_orders(spark, folder), ["o_orderkey"])
    store = DetailStore(spark, storage.new_folder(spark, "details"))
    store.save("run", {"Missing in Target": diff.missing(), "Extra in Target": diff.extra()})
    return _section_counts(store.load_all("run"))


def _section_counts(sections):
    out = None
    for title, df in sections.items():
        part = df.agg(
            F.count("*").alias("rows"), F.sum(F.col("o_orderkey").cast("bigint")).alias("key_sum")
        ).select(F.lit(title).alias("section"), "rows", "key_sum")
        out = part if out is None else out.unionByName(part)
    return out


SECTIONS_SQL = f"""{PAIRS} SELECT CASE diff_status WHEN 'extra_in_target' THEN 'Extra in Target'
       ELSE 'Missing in Target' END AS section,
       count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM pairs WHERE diff_status IN ('missing_in_target', 'extra_in_target') GROUP BY 1"""


def export_manifest(spark, folder):
    return reports.export_manifest(D.runs(spark, folder)).select("folder", "run_id", "module", "name", "status")


MANIFEST_SQL = f"""WITH {D.RUNS_SQL}
SELECT CASE module WHEN 'Duplicate Validation' THEN 'DV-' WHEN 'Record Count Validation' THEN 'RC-'
       WHEN 'Full Data Validation' THEN 'FD-' WHEN 'Schema Validation' THEN 'SC-' ELSE 'RI-' END
       || run_id AS folder, run_id, module, name, status FROM runs"""


def suite_batch(spark, folder):
    """Saved checks over the given tables, one of them broken and one unknown."""

    def side(name):
        return {"path": f"{folder}/{name}.parquet"}

    lines, orders, customers = side("lineitem"), side("orders"), side("customer")
    quantity = [{"column": "l_quantity", "function": f} for f in ("SUM", "MIN", "MAX", "COUNT_DISTINCT")]
    described = [
        ("customer keys", "Duplicate Validation", customers, None, {"keys": ["c_custkey"]}),
        ("line keys", "Duplicate Validation", lines, None, {"keys": ["l_orderkey", "l_linenumber"]}),
        ("orders to customers", "Referential Integrity", orders, customers,
         {"child_keys": ["o_custkey"], "parent_keys": ["c_custkey"]}),
        ("broken", "Duplicate Validation", orders, None, {"keys": ["no_such_column"]}),
        ("lines as lines", "Record Count Validation", lines, lines, {}),
        ("lines as orders", "Record Count Validation", lines, orders, {"tolerance_percent": 10.0}),
        ("filled lines", "Nullability Validation", lines, None, {"sentinels": ["N"]}),
        ("quantities", "Aggregation Validation", lines, lines, {"metrics": quantity}),
        ("no metric", "Aggregation Validation", lines, lines, {"metrics": []}),
    ]
    suites = {
        str(i): Suite(str(i), name, module, {"source": source, "target": target, "settings": settings})
        for i, (name, module, source, target, settings) in enumerate(described, 1)
    }
    table = RunTable(spark, storage.new_folder(spark, "runs"))
    outcomes = outcomes_frame(spark, run_suites(table, suites, [*suites, "none"], at_once=4))

    def figure(key):
        return F.get_json_object("summary", f"$.{key}").cast("double")

    kept = {
        "rows": F.coalesce(figure("total_rows"), figure("source_count"), figure("child_rows")),
        "found": F.coalesce(*map(figure, ("duplicate_row_count", "orphan_rows", "difference", "rows_failed"))),
        "score": figure("completeness_score"),
    }
    return outcomes.select("position", "name", "module", "status", *[c.alias(n) for n, c in kept.items()])


def _filled_lines_sql() -> str:
    """Mean completeness of the columns of lineitem, with 'N' as a sentinel; no other column can hold it."""
    columns = (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ).split()
    texts = ("l_returnflag", "l_linestatus")
    missing = [
        f"count(*) FILTER (WHERE {c} IS NULL" + (f" OR trim({c}) IN ('', 'N'))" if c in texts else ")")
        for c in columns
    ]
    return f"100.0 * (1 - ({' + '.join(missing)}) / (count(*) * {len(columns)}.0))"


SUITE_BATCH_SQL = f"""WITH d AS (
  SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders,
         (SELECT count(*) FROM lineitem) AS lines, (SELECT {_filled_lines_sql()} FROM lineitem) AS filled,
         (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey) WHERE n > 1) AS c_twice,
         (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
          WHERE n > 1) AS l_twice,
         (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans
), r AS (
  SELECT 0 AS position, 'DV_customer keys' AS name, 'Duplicate Validation' AS module, c_twice = 0 AS ok, customers AS rows,
         c_twice AS found, NULL AS score FROM d
  UNION ALL SELECT 1, 'DV_line keys', 'Duplicate Validation', l_twice = 0, lines, l_twice, NULL FROM d
  UNION ALL SELECT 2, 'RI_orders to customers', 'Referential Integrity', orphans = 0, orders, orphans, NULL FROM d
  UNION ALL SELECT 3, 'broken', 'Duplicate Validation', NULL, NULL, NULL, NULL
  UNION ALL SELECT 4, 'RC_lines as lines', 'Record Count Validation', true, lines, 0, NULL FROM d
  UNION ALL SELECT 5, 'RC_lines as orders', 'Record Count Validation', abs(orders - lines) <= lines / 10.0, lines,
         orders - lines, NULL FROM d
  UNION ALL SELECT 6, 'NV_filled lines', 'Nullability Validation', filled >= 100, lines, NULL, round(filled, 4) FROM d
  UNION ALL SELECT 7, 'AG_quantities', 'Aggregation Validation', true, NULL, 0, NULL
  UNION ALL SELECT 8, 'no metric', 'Aggregation Validation', NULL, NULL, NULL, NULL
  UNION ALL SELECT 9, 'none', '', NULL, NULL, NULL, NULL
)
SELECT CAST(position AS INTEGER) AS position, name, module,
       CASE WHEN ok THEN 'PASS' WHEN NOT ok THEN 'FAIL' ELSE 'ERROR' END AS status,
       CAST(rows AS DOUBLE) AS rows, CAST(found AS DOUBLE) AS found, CAST(score AS DOUBLE) AS score FROM r"""


QUERIES = {
    "run_state": (run_state, f"{CURRENT} SELECT run_id, module, status, archived FROM current_runs"),
    "run_history": (
        run_history,
        f"""{CURRENT} SELECT {', '.join(SHOWN)} FROM current_runs
WHERE module = 'Duplicate Validation' AND NOT archived ORDER BY started_at DESC, run_id LIMIT 200""",
    ),
    "run_totals": (
        run_totals,
        f"{CURRENT} SELECT {TOTALS}",
    ),
    "project_report": (
        _project("Runs by Module"),
        f"{CURRENT} SELECT module, count(*) AS total, {COUNTS} FROM {CURRENTLY} GROUP BY module",
    ),
    "project_summary": (_project("Summary"), f"{CURRENT} SELECT 'demo' AS project, {TOTALS}"),
    "project_history": (
        _project("Run History"),
        f"""{CURRENT} SELECT started_at, module, name, status, runtime_seconds, coalesce(error, '') AS error_message
FROM {CURRENTLY}""",
    ),
    "pass_rate_by_day": (
        pass_rate_by_day,
        f"""{CURRENT} SELECT CAST(started_at AS DATE) AS date, count(*) AS total,
  count(*) FILTER (WHERE status = 'PASS') AS passed,
  round(count(*) FILTER (WHERE status = 'PASS') / count(*) * 100.0, 2) AS pass_rate_percent
FROM current_runs WHERE NOT archived GROUP BY 1""",
    ),
    "runs_by_module": (
        runs_by_module,
        f"{CURRENT} SELECT module, count(*) AS total, {COUNTS} FROM current_runs WHERE NOT archived GROUP BY module",
    ),
    "runtime_trend": (
        runtime_trend,
        f"{CURRENT} SELECT started_at, module, runtime_seconds FROM current_runs WHERE NOT archived",
    ),
    "suite_report": (
        suite_report,
        f"""{_suites_sql()} SELECT suites.name AS test_suite, coalesce(status, 'never run') AS status,
  last_run_at AS last_run, json_extract_string(summary, '$.k') AS k
FROM suites LEFT JOIN runs ON run_id = last_run_id WHERE suites.module = 'Duplicate Validation'""",
    ),
    "suite_totals": (
        suite_totals,
        f"""{_suites_sql()} SELECT suites.module, count(*) AS suites,
  count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed
FROM suites LEFT JOIN runs ON run_id = last_run_id GROUP BY suites.module""",
    ),
    "batch_ranges": (
        batch_ranges,
        """WITH n AS (SELECT row_number() OVER () AS rn FROM lineitem), b AS (
  SELECT (rn - 1) // 7000 + 1 AS number, min(rn) AS first_row, max(rn) AS last_row FROM n GROUP BY 1
)
SELECT CASE WHEN count(*) OVER () = 1 THEN 'LINEITEM' ELSE 'LINEITEM_' || CAST(number AS VARCHAR) END AS name,
       CAST(number AS BIGINT) AS number, count(*) OVER () AS total, first_row, last_row FROM b""",
    ),
    "numbered_rows": (
        numbered_rows,
        """SELECT event_type, ts, event_id, rn AS row_number, CAST((rn - 1) // 3000 + 1 AS BIGINT) AS batch FROM (
  SELECT *, row_number() OVER (ORDER BY event_type, ts, event_id) AS rn FROM events)""",
    ),
    "batch_files": (batch_files, BATCH_FILES_SQL),
    "csv_report": (csv_report, SECTIONS_SQL),
    "json_report": (json_report, SECTIONS_SQL),
    "report_titles": (report_titles, REPORT_TITLES_SQL),
    "detail_roundtrip": (detail_roundtrip, SECTIONS_SQL),
    "export_manifest": (export_manifest, MANIFEST_SQL),
    "suite_batch": (suite_batch, SUITE_BATCH_SQL),
}
