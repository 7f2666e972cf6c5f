"""Saved checks, run together."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from countercheck.plans.checks import Check, CheckError, Outcome, run_check
from countercheck.plans.shared import shared
from countercheck.sinks import storage
from countercheck.sinks.reports import with_code
from countercheck.sinks.run_table import RunTable

# Modules that can be saved as a suite.
RUNNABLE = (
    "Schema Validation",
    "Record Count Validation",
    "Duplicate Validation",
    "Nullability Validation",
    "Aggregation Validation",
    "Full Data Validation",
    "Referential Integrity",
)


@dataclass(frozen=True)
class Suite:
    """A saved check. ``config`` has source, target and settings, and can be
    kept as JSON."""

    suite_id: str
    name: str
    module: str
    config: Mapping[str, object] = field(default_factory=dict)
    project_id: str = "default"

    @classmethod
    def from_json(cls, text: str) -> Suite:
        return cls(**json.loads(text))

    def check(self) -> Check:
        if self.module not in RUNNABLE:
            raise CheckError(f"'{self.module}' cannot be run from a saved suite.")
        config = dict(self.config)
        return Check(
            module=self.module,
            source=config.pop("source", None),
            target=config.pop("target", None),
            settings=config.pop("settings", {}),
            name=with_code(self.module, self.name),
        )


def run_suites(
    table: RunTable,
    suites: Mapping[str, Suite],
    suite_ids: Sequence[str],
    at_once: int = 1,
) -> list[Outcome]:
    """Run saved checks and return one outcome each, in the order asked. One
    that fails, or an id that is not known, never stops the others.

    Sides that several checks take one row of figures from are scanned once,
    before the checks start (see ``shared``); a run's time then leaves out its
    part of the scan. With ``at_once`` above 1, that many checks submit their
    jobs side by side.
    """
    checks = {}
    for suite_id in dict.fromkeys(suite_ids):
        try:
            checks[suite_id] = suites[suite_id].check()
        except Exception:  # unknown or not described well: its outcome below says so
            continue

    def run(suite_id: str) -> Outcome:
        suite = suites.get(suite_id)
        if suite is None:
            return Outcome(suite_id, "", "ERROR", None, {}, f"Suite '{suite_id}' not found.")
        try:
            check = checks.get(suite_id) or suite.check()
            return run_check(table, check, suite.project_id, suite.suite_id, answers.get(suite_id))
        except Exception as problem:
            return Outcome(suite.name, suite.module, "ERROR", None, {}, str(problem))

    with storage.owned(table.spark):
        answers = shared(table.spark, checks)
        if at_once <= 1:
            return [run(s) for s in suite_ids]
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            return list(pool.map(inheritable_thread_target(table.spark)(run), suite_ids))


def outcomes_frame(spark: SparkSession, outcomes: Sequence[Outcome]) -> DataFrame:
    """Outcomes as rows: one per suite."""
    rows = [
        (i, o.name, o.module, o.status, o.run_id, json.dumps(o.summary, default=str), o.error)
        for i, o in enumerate(outcomes)
    ]
    return spark.createDataFrame(
        rows,
        "position int, name string, module string, status string, run_id string, "
        "summary string, error string",
    )
