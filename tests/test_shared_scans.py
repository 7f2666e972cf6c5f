"""Checks of a batch that read the same side share one scan of it."""

import pytest

from countercheck.plans import shared as S
from countercheck.plans.checks import Check, run_check
from countercheck.plans.suites import Suite, run_suites
from countercheck.sinks.run_table import RunTable


@pytest.fixture
def sides(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else i / 8, "N/A" if i % 5 == 0 else f"t{i}") for i in range(100)]
    spark.createDataFrame(rows, "id bigint, x double, t string").write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame(rows[:90], "id bigint, x double, t string").write.parquet(str(tmp_path / "b.parquet"))
    return {"path": str(tmp_path / "a.parquet")}, {"path": str(tmp_path / "b.parquet")}


def described(a, b):
    metrics = [{"column": c, "function": f} for c, f in (("X", "SUM"), ("x", "AVG"), ("id", "MAX"), ("t", "COUNT_DISTINCT"))]
    return {
        "count": Check("Record Count Validation", a, b, {"tolerance_percent": 9.0}),
        "same": Check("Record Count Validation", a, a),
        "nulls": Check("Nullability Validation", a, None, {"columns": ["x", "t"], "threshold_percent": 50.0}),
        "totals": Check("Aggregation Validation", a, b, {"metrics": metrics, "tolerance_percent": 1.0}),
        "by group": Check("Record Count Validation", a, b, {"group_by": ["t"]}),
        "no column": Check("Nullability Validation", a, None, {"columns": ["y"]}),
        "no number": Check("Aggregation Validation", a, b, {"metrics": [{"column": "t", "function": "SUM"}]}),
        "keys": Check("Duplicate Validation", a, None, {"keys": ["id"]}),
    }


def test_one_scan_a_side(spark, sides, monkeypatch):
    read, run = [], []
    plain_read, plain_run = S.read_side, S.Scan.run

    def counted_run(scan):
        run.append(S.aggregates.measured(scan.side, [], scan.metrics, scan.conditions))
        plain_run(scan)

    monkeypatch.setattr(S, "read_side", lambda *a: read.append(a) or plain_read(*a))
    monkeypatch.setattr(S.Scan, "run", counted_run)
    answers = S.shared(spark, described(*sides))
    assert set(answers) == {"count", "same", "nulls", "totals"}  # others need rows, or cannot be answered
    assert len(read) == 2 and len(run) == 2
    for df in run:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1


def test_same_results_as_alone(spark, sides, tmp_path):
    table = RunTable(spark, str(tmp_path / "runs"))
    checks = described(*sides)
    answers = S.shared(spark, checks)
    for name, answer in answers.items():
        alone, together = run_check(table, checks[name]), run_check(table, checks[name], measured=answer)
        assert (together.status, together.summary) == (alone.status, alone.summary)
        parts = [table.details.load_all(o.run_id) for o in (alone, together)]
        assert list(parts[0]) == list(parts[1])
        for title in parts[0]:
            assert sorted(parts[0][title].collect(), key=repr) == sorted(parts[1][title].collect(), key=repr)
            assert parts[0][title].dtypes == parts[1][title].dtypes


def test_empty_side_and_failing_scan(spark, sides, tmp_path, monkeypatch):
    a, _ = sides
    spark.createDataFrame([], "id bigint, x double, t string").write.parquet(str(tmp_path / "e.parquet"))
    empty = {"path": str(tmp_path / "e.parquet")}
    table = RunTable(spark, str(tmp_path / "runs"))

    def batch():
        suites = {n: Suite(n, n, c.module, {"source": c.source, "target": c.target, "settings": c.settings})
                  for n, c in described(empty, a).items()}
        return {o.name: (o.status, o.summary) for o in run_suites(table, suites, list(suites))}

    together = batch()
    assert together["RC_same"] == ("PASS", {"source_count": 0, "target_count": 0, "difference": 0, "variance_percent": 0.0})
    assert together["NV_nulls"] == ("PASS", {"total_rows": 0, "completeness_score": 100.0})
    assert together["RC_count"][0] == "FAIL" and together["AG_totals"][0] == "FAIL"
    assert together["no column"][0] == together["no number"][0] == "ERROR"

    def broken(scan):
        raise OSError("lost")

    monkeypatch.setattr(S.Scan, "run", broken)
    assert batch() == together


def test_group_totals_come_from_the_breakdown(spark, sides, tmp_path):
    a, b = sides
    table = RunTable(spark, str(tmp_path / "runs"))
    plain = run_check(table, Check("Record Count Validation", a, b))
    grouped = run_check(table, Check("Record Count Validation", a, b, {"group_by": ["x"]}))
    assert grouped.summary == plain.summary and plain.summary["source_count"] == 100
