"""Reports over past runs. A run table has the columns of ``RUNS``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions import values as V

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("runtime_seconds", T.DoubleType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("suite_id", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("finished_at", T.TimestampNTZType()),
    ]
)

STATE_EVENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
    ]
)

# Modules, their short codes, and how many runs a report covers.
MODULE_CODES = {
    "Schema Validation": "SC",
    "Record Count Validation": "RC",
    "Duplicate Validation": "DV",
    "Nullability Validation": "NV",
    "Aggregation Validation": "AG",
    "Full Data Validation": "FD",
    "Referential Integrity": "RI",
    "Data Profiling": "DP",
    "File Comparison": "FC",
}
ARCHIVE, RESTORE, DELETE = "archive", "restore", "delete"


def with_state(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with ``archived``, without the deleted ones. The latest event of a
    run decides, except that a deletion is for good. Events are folded to one
    row per run, per map task first, before they meet the runs."""
    state = events.groupBy("run_id").agg(
        F.max(F.struct("at", "action")).alias("latest"),
        F.bool_or(F.col("action") == DELETE).alias("deleted"),
    )
    return (
        runs.join(state, "run_id", "left")
        .filter(~F.coalesce("deleted", F.lit(False)))
        .withColumn(
            "archived", F.coalesce(F.col("latest.action") == ARCHIVE, F.lit(False))
        )
        .drop("latest", "deleted")
    )


def run_history(
    runs: DataFrame,
    project_id: str | None = None,
    module: str | None = None,
    suite_id: str | None = None,
    limit: int | None = None,
    include_archived: bool = False,
) -> DataFrame:
    """The newest runs that match, newest first; ties in run id order."""
    for column, wanted in (("project_id", project_id), ("module", module), ("suite_id", suite_id)):
        if wanted is not None:
            runs = runs.filter(F.col(column) == wanted)
    if not include_archived and "archived" in runs.columns:
        runs = runs.filter(~F.col("archived"))
    newest = runs.orderBy(F.desc("started_at"), "run_id")
    return newest.limit(limit) if limit is not None else newest


def _status_counts() -> list:
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "ERROR").alias("errored"),
    ]


def _pass_rate(total: str):
    return F.round(V.percent_of(F.col("passed"), F.col(total), 0.0), 2).alias("pass_rate_percent")


def run_totals(history: DataFrame) -> DataFrame:
    """One row: runs by status and the pass rate."""
    counted = history.agg(*_status_counts()).withColumnRenamed("total", "total_runs")
    return counted.select("total_runs", "passed", "failed", "errored", _pass_rate("total_runs"))


def pass_rate_by_day(history: DataFrame) -> DataFrame:
    return (
        history.groupBy(F.to_date("started_at").alias("date"))
        .agg(*_status_counts())
        .select("date", "total", "passed", _pass_rate("total"))
        .orderBy("date")
    )


def runs_by_module(history: DataFrame) -> DataFrame:
    """Status counts per module, busiest first."""
    return history.groupBy("module").agg(*_status_counts()).orderBy(F.desc("total"), "module")


def runtime_trend(history: DataFrame) -> DataFrame:
    return history.select("started_at", "module", "runtime_seconds").orderBy("started_at", "module")


def history_table(history: DataFrame) -> DataFrame:
    return history.select(
        "started_at",
        "module",
        "name",
        "status",
        "runtime_seconds",
        F.coalesce("error", F.lit("")).alias("error_message"),
    ).orderBy(F.desc("started_at"), "name")


def project_report(history: DataFrame, project_name: str) -> dict[str, DataFrame]:
    """Named tables of a project report, in reading order. A history without
    runs leaves only the summary."""
    summary = run_totals(history).select(F.lit(project_name).alias("project"), "*")
    tables = {"Summary": summary}
    if not history.isEmpty():
        tables["Runs by Module"] = runs_by_module(history)
        tables["Pass Rate Trend"] = pass_rate_by_day(history)
        tables["Run History"] = history_table(history)
    return tables


# What each module writes into a run's summary.
MODULE_METRICS: Mapping[str, Sequence[str]] = {
    "Schema Validation": ("columns_compared", "mismatches", "attribute_mismatches"),
    "Record Count Validation": (
        "source_count",
        "target_count",
        "difference",
        "variance_percent",
    ),
    "Duplicate Validation": (
        "total_rows",
        "duplicate_key_count",
        "duplicate_row_count",
        "duplicate_percent",
    ),
    "Nullability Validation": ("total_rows", "completeness_score"),
    "Aggregation Validation": ("metrics_compared", "rows_compared", "rows_failed"),
    "Full Data Validation": (
        "rows_source",
        "rows_target",
        "rows_compared",
        "rows_matched",
        "rows_mismatched",
        "rows_missing_in_target",
        "rows_extra_in_target",
        "rows_failed",
        "success_percentage",
        "execution_start",
        "execution_end",
    ),
    "Referential Integrity": (
        "child_rows",
        "checked_rows",
        "null_key_rows",
        "orphan_rows",
        "orphan_percent",
        "distinct_orphan_keys",
    ),
    "Data Profiling": ("total_rows", "columns_profiled"),
    "File Comparison": ("files_compared", "files_failed"),
}


def with_last_run(suites: DataFrame, runs: DataFrame) -> DataFrame:
    """Saved suites with the id, status and time of their latest run. Runs are
    folded to one per suite, per map task first."""
    latest = (
        runs.filter(F.col("suite_id").isNotNull())
        .groupBy("suite_id")
        .agg(F.max(F.struct("started_at", "run_id", "status", "finished_at")).alias("latest"))
    )
    return suites.join(latest, "suite_id", "left").select(
        *suites.columns,
        F.col("latest.run_id").alias("last_run_id"),
        F.col("latest.status").alias("last_run_status"),
        F.col("latest.finished_at").alias("last_run_at"),
    )


def suite_report(
    suites: DataFrame, runs: DataFrame, module: str, metrics: Sequence[str] | None = None
) -> DataFrame:
    """Every saved suite of a module with its last run, by suite name.

    ``suites`` has name, module, last_run_id, last_run_status, last_run_at.
    The summary of the last run becomes one column per metric. A suite that
    never ran, or whose run is gone, keeps its row.
    """
    metrics = MODULE_METRICS[module] if metrics is None else metrics
    summary = F.from_json("summary", "map<string,string>")
    last = runs.select(F.col("run_id").alias("last_run_id"), summary.alias("metric"))
    return (
        suites.filter(F.col("module") == module)
        .join(last, "last_run_id", "left")
        .select(
            F.col("name").alias("test_suite"),
            F.coalesce("last_run_status", F.lit("never run")).alias("status"),
            F.col("last_run_at").alias("last_run"),
            *[F.col("metric")[m].alias(m) for m in metrics],
        )
        .orderBy("test_suite")
    )


def suite_totals(suites: DataFrame) -> DataFrame:
    """Suites per module, with how many passed and failed on their last run."""
    return (
        suites.groupBy("module")
        .agg(
            F.count("*").alias("suites"),
            F.count_if(F.col("last_run_status") == "PASS").alias("passed"),
            F.count_if(F.col("last_run_status") == "FAIL").alias("failed"),
        )
        .orderBy("module")
    )
