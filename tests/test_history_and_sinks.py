import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from countercheck.operators import history as H
from countercheck.plans.checks import Check, run_check
from countercheck.plans.suites import Suite, outcomes_frame, run_suites
from countercheck.sinks import reports as R
from countercheck.sinks import storage
from countercheck.sinks.details import DetailStore
from countercheck.sinks.run_table import RunTable


def runs(spark):
    day = dt.datetime(2024, 5, 1, 10)
    rows = [
        ("r1", "Record Count Validation", "PASS", 0, "p1"),
        ("r2", "Record Count Validation", "PASS", 24, "p1"),
        ("r3", "Duplicate Validation", "FAIL", 25, "p1"),
        ("r4", "Schema Validation", "ERROR", 49, "p2"),
    ]
    return spark.createDataFrame(
        [
            (i, m, i + "_name", s, json.dumps({"total_rows": 3}), None, None, None, 1.5, p, None,
             day + dt.timedelta(hours=h), day + dt.timedelta(hours=h))
            for i, m, s, h, p in rows
        ],
        H.RUNS,
    )


def test_dashboard(spark):
    df = runs(spark)
    assert tuple(H.run_totals(df).first()) == (4, 2, 1, 1, 50.0)
    days = H.pass_rate_by_day(df).collect()
    assert [(r["total"], r["passed"], r["pass_rate_percent"]) for r in days] == [
        (1, 1, 100.0), (2, 1, 50.0), (1, 0, 0.0),
    ]
    assert [tuple(r) for r in H.runs_by_module(df).collect()][0] == ("Record Count Validation", 2, 2, 0, 0)
    assert [r["module"] for r in H.runtime_trend(df).collect()][-1] == "Schema Validation"
    assert tuple(H.run_totals(df.limit(0)).first()) == (0, 0, 0, 0, 0.0)


def test_run_history(spark):
    df = runs(spark).withColumn("archived", F.col("run_id") == "r3")
    ids = lambda **k: [r["run_id"] for r in H.run_history(df, **k).collect()]
    assert ids() == ["r4", "r2", "r1"]
    assert ids(include_archived=True, limit=2) == ["r4", "r3"]
    assert ids(project_id="p1") == ["r2", "r1"]
    assert ids(module="Schema Validation") == ["r4"]
    assert ids(suite_id="none") == []


def test_project_report(spark):
    tables = H.project_report(runs(spark), "demo")
    assert list(tables) == ["Summary", "Runs by Module", "Pass Rate Trend", "Run History"]
    assert tables["Summary"].first()["project"] == "demo"
    assert tables["Run History"].first()["error_message"] == ""
    assert list(H.project_report(runs(spark).limit(0), "demo")) == ["Summary"]


def test_state_events(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [("r1", "archive", t), ("r2", "archive", t), ("r2", "restore", t + dt.timedelta(1)),
         ("r3", "delete", t), ("r3", "restore", t + dt.timedelta(1))],
        H.STATE_EVENTS,
    )
    state = {r["run_id"]: r["archived"] for r in H.with_state(runs(spark), events).collect()}
    assert state == {"r1": True, "r2": False, "r4": False}


def test_suite_report(spark):
    suites = spark.createDataFrame(
        [("b", "Record Count Validation", "r1", "PASS", dt.datetime(2024, 5, 1)),
         ("a", "Record Count Validation", None, None, None),
         ("c", "Record Count Validation", "gone", "FAIL", None),
         ("d", "Duplicate Validation", "r3", "FAIL", None)],
        "name string, module string, last_run_id string, last_run_status string, last_run_at timestamp_ntz",
    )
    rows = H.suite_report(suites, runs(spark), "Record Count Validation", ["total_rows"]).collect()
    assert [(r["test_suite"], r["status"], r["total_rows"]) for r in rows] == [
        ("a", "never run", None), ("b", "PASS", "3"), ("c", "FAIL", None),
    ]
    assert [tuple(r) for r in H.suite_totals(suites).collect()] == [
        ("Duplicate Validation", 1, 0, 1), ("Record Count Validation", 3, 1, 1),
    ]


def test_detail_store(spark, tmp_path):
    store = DetailStore(spark, str(tmp_path / "details"))
    a, b = spark.range(3), spark.range(5)
    store.save("run1", {"Rows / A": a, "Rows  A": b, "": a.limit(0)})
    store.save("empty", {})
    assert store.sections("run1") == ["Rows / A", "Rows  A", ""]
    assert store.load("run1", "Rows  A").count() == 5
    assert store.load("run1", "nope") is None and store.load("nope", "x") is None
    assert {k: v.count() for k, v in store.load_all("run1").items()} == {"Rows / A": 3, "Rows  A": 5, "": 0}
    assert store.has_detail("run1") and not store.has_detail("empty")
    assert store.delete("run1") and not store.delete("run1")
    assert store.load_all("run1") == {}


@pytest.mark.parametrize(("rows", "size", "names"), [(0, 5, ["X"]), (5, 5, ["X"]), (11, 5, ["X_1", "X_2", "X_3"])])
def test_batches(spark, tmp_path, rows, size, names):
    df = spark.range(rows).select((F.col("id") % 3).alias("g"), F.col("id").alias("batch"))
    ranges = R.batch_ranges(df, "X", size).collect()
    assert [r["name"] for r in ranges] == names
    assert (ranges[0]["first_row"], ranges[-1]["last_row"]) == (min(rows, 1), rows)
    path = str(tmp_path / f"b{rows}")
    assert R.write_batches(df, path, "X", ["g", "batch"], size) == names
    if rows:
        back = spark.read.option("header", "true").csv(path)
        assert back.count() == rows and back.select("batch").distinct().count() == rows
        sizes = sorted(r["count"] for r in back.groupBy("batch_").count().collect())
        assert sizes == sorted(r["last_row"] - r["first_row"] + 1 for r in ranges)


def test_batch_rows_must_be_positive(spark):
    with pytest.raises(ValueError):
        R.batch_ranges(spark.range(1), "X", 0)


def test_row_numbers_follow_the_order(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("v"), F.lit("same").alias("hot"))
    numbered = R.number_rows(df, ["hot", "v"])
    assert numbered.filter("row_number <> v + 1").count() == 0
    assert "Window" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_csv_and_json_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', None, ["a"])], "id int, t string, n string, l array<string>")
    out = R.write_csv_report(spark, str(tmp_path / "c"), {"total": 1}, {"Rows": df, "More": df.limit(0)})
    assert list(out) == ["Rows", "More"] and (tmp_path / "c" / "summary").is_dir()
    listed = spark.read.csv(str(tmp_path / "c" / "sections"), header=True).orderBy("position")
    assert [r["title"] for r in listed.collect()] == ["Rows", "More"]
    back = spark.read.options(header="true", escape='"').csv(out["Rows"]).first()
    assert tuple(back) == ("1", 'say "hi", ok', None, '["a"]')
    text = "".join(p.read_text() for p in (tmp_path / "c" / "section-0001").glob("*.csv"))
    assert text == "id,t,n,l\n"
    assert list(R.write_csv_report(spark, str(tmp_path / "one"), {}, {"Rows": df})) == ["Rows"]
    assert list(R.write_csv_report(spark, str(tmp_path / "none"), {"a": 1}, {})) == []
    written = R.write_json_report(spark, str(tmp_path / "j"), "T", {"total": 1}, {"Rows": df, "report": df})
    assert spark.read.json(str(tmp_path / "j" / "report")).first()["sections"] == ["Rows", "report"]
    assert spark.read.json(written["report"]).first()["t"] == 'say "hi", ok'


def test_names():
    assert R.with_code("Record Count Validation", "rc_customers") == "RC_customers"
    assert R.with_code("Duplicate Validation", " x ") == "DV_x"


def test_run_table_and_export(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "runs"))
    assert table.runs().count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, name string")
    first = run_check(table, Check("Duplicate Validation", df, settings={"keys": ["ID"]}, name="nightly"))
    second = run_check(table, Check("Duplicate Validation", df, settings={"keys": ["name"]}, name="nightly"))
    assert (first.status, second.status) == ("FAIL", "PASS")
    assert table.get(first.run_id)["summary"] == json.dumps(dict(first.summary))
    with pytest.raises(ValueError):
        run_check(table, Check("Duplicate Validation", df, settings={"keys": ["nope"]}, name="broken"))
    assert [r["status"] for r in H.run_history(table.runs()).collect()] == ["ERROR", "PASS", "FAIL"]

    manifest = R.export_runs(table, [first.run_id, second.run_id, "gone"], str(tmp_path / "out"), 1)
    folders = {r["run_id"]: r["folder"] for r in manifest.collect()}
    assert folders == {r: f"DV-{r}" for r in (first.run_id, second.run_id)}
    rows = spark.read.option("header", "true").csv(str(tmp_path / "out" / folders[first.run_id] / "section-0000"))
    assert rows.count() == 2 and rows.select("batch").distinct().count() == 2
    summary = spark.read.option("header", "true").csv(str(tmp_path / "out" / folders[first.run_id] / "summary"))
    assert {r["metric"]: r["value"] for r in summary.collect()}["duplicate_key_count"] == "1"

    assert table.archive([first.run_id, "gone"]) == {first.run_id: "done", "gone": "unknown"}
    assert len(H.run_history(table.runs()).collect()) == 2
    assert table.restore([first.run_id]) == {first.run_id: "done"}
    assert len(H.run_history(table.runs()).collect()) == 3
    assert table.delete([first.run_id]) == {first.run_id: "done"}
    assert not table.details.has_detail(first.run_id) and table.get(first.run_id) is None
    assert table.delete([first.run_id]) == {first.run_id: "unknown"}
    assert table.archive([]) == {}


def test_every_module_runs(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "runs"))
    s = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "id int, v double, t string")
    t = spark.createDataFrame([(1, 1.0, "a"), (2, 3.0, "b")], "ID int, v double, t string")
    path = str(tmp_path / "f")
    s.coalesce(1).write.csv(path)
    checks = {
        "Schema Validation": (s, t, {}, "PASS"),
        "Record Count Validation": (s, t, {"group_by": ["t"]}, "PASS"),
        "Duplicate Validation": (s, None, {"keys": ["id"]}, "PASS"),
        "Nullability Validation": (s, None, {"columns": ["t"]}, "PASS"),
        "Aggregation Validation": (s, t, {"metrics": [{"column": "v", "function": "SUM"}]}, "FAIL"),
        "Full Data Validation": (s, t, {"keys": ["id"]}, "FAIL"),
        "Referential Integrity": (s, t, {"child_keys": ["id"], "parent_keys": ["id"]}, "PASS"),
        "Data Profiling": (s, None, {}, "PASS"),
        "File Comparison": (path, path, {}, "PASS"),
    }
    for module, (source, target, settings, status) in checks.items():
        outcome = run_check(table, Check(module, source, target, settings))
        assert outcome.status == status, module
        assert set(H.MODULE_METRICS[module]) <= set(outcome.summary), module
        if module == "Full Data Validation":
            assert table.details.sections(outcome.run_id) == [
                "Mismatches", "Missing in Target", "Extra in Target", "Matched",
            ]
            assert table.details.load(outcome.run_id, "Mismatches").first()["MISMATCHED_COLUMNS"] == "v"
    with pytest.raises(ValueError, match="Unknown module"):
        run_check(table, Check("Nope", s))
    twice = s.unionByName(s)
    with pytest.raises(ValueError, match=r"source: 2 row\(s\)"):
        run_check(table, Check("Full Data Validation", twice, t, {"keys": ["id"]}))
    empty = run_check(table, Check("Full Data Validation", s.limit(0), t.limit(0), {"keys": ["id"]}))
    assert empty.summary["success_percentage"] == 100.0


@pytest.mark.parametrize("at_once", [1, 3])
def test_suites(spark, tmp_path, at_once):
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    source = {"path": str(tmp_path / "a.parquet")}
    suites = {
        "s1": Suite.from_json(json.dumps({
            "suite_id": "s1", "name": "ids", "module": "Duplicate Validation",
            "config": {"source": source, "settings": {"keys": ["id"]}},
        })),
        "s2": Suite("s2", "broken", "Duplicate Validation", {"source": source, "settings": {"keys": ["x"]}}),
        "s3": Suite("s3", "prof", "Data Profiling", {"source": source}),
    }
    table = RunTable(spark, str(tmp_path / "runs"))
    outcomes = run_suites(table, suites, ["s2", "s1", "s9", "s3"], at_once)
    assert [o.status for o in outcomes] == ["ERROR", "PASS", "ERROR", "ERROR"]
    assert "not found" in outcomes[2].error
    assert outcomes_frame(spark, outcomes).filter("status = 'PASS'").first()["name"] == "DV_ids"
    assert table.runs().filter("suite_id = 's1'").count() == 1
    saved = spark.createDataFrame([("s1", "ids"), ("s7", "new")], "suite_id string, name string")
    last = {r["name"]: r["last_run_status"] for r in H.with_last_run(saved, table.runs()).collect()}
    assert last == {"ids": "PASS", "new": None}


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_batch_ranges_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "LISTED", 3)
    rows = R.batch_ranges(spark.range(20), "T", 2).collect()
    assert [(r["name"], r["number"], r["total"], r["first_row"], r["last_row"]) for r in rows] == [
        (f"T_{n}", n, 10, 2 * n - 1, 2 * n) for n in range(1, 11)
    ]
    assert [tuple(r) for r in R.batch_ranges(spark.range(0), "T", 2).collect()] == [("T", 1, 1, 0, 0)]
