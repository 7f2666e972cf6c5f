"""The run table packed: few files, months pruned, nothing lost or doubled."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from countercheck.operators.history import RUNS
from countercheck.sinks import packed_log, storage
from countercheck.sinks.run_table import RunTable, month_of, new_run_id

DAY = dt.datetime(2026, 3, 5, 10)


def many(spark, first, last):
    at = F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 365))")
    known = {
        "run_id": F.concat(F.date_format(at, "yyyyMMdd"), F.lit("-"), F.lpad(F.col("id").cast("string"), 8, "0")),
        "module": F.lit("Data Profiling"), "status": F.lit("PASS"), "started_at": at, "finished_at": at,
    }
    cells = [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RUNS.fields]
    return spark.range(first, last).select(*cells)


def test_many_runs_are_few_files_and_a_look_up_reads_one_month(spark, tmp_path):
    table = RunTable(spark, str(tmp_path))
    for i in range(7):
        table._runs.add(many(spark, i * 15_000, (i + 1) * 15_000))
        assert table.pack()
    assert not table.pack()
    assert len(list(tmp_path.rglob("*.parquet"))) <= 100
    runs = table.runs()
    assert runs.count() == 105_000 == runs.select("run_id").distinct().count()
    assert table.get("20250201-00000031")["started_at"] == dt.datetime(2025, 2, 1)
    assert table.get("20250301-00000031") is None
    read = table._runs.read(month_of("20250201-00000031"))
    assert read._jdf.queryExecution().executedPlan().toString().count("month#") >= 1
    months = {r[0] for r in read.select(F.date_format("started_at", "yyyy-MM")).distinct().collect()}
    assert months == {"2025-02"}
    assert "PartitionFilters: [isnotnull(month" in read._jdf.queryExecution().executedPlan().toString()


def test_state_and_ids_of_any_form(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed_log, "MERGE_AT", 1)
    table = RunTable(spark, str(tmp_path))
    ids = [table.record("Data Profiling", n, "PASS", DAY, run_id=i) for n, i in (("a", None), ("b", "plain"), ("c", "20261399-x"))]
    assert ids[0].startswith("20260305-") and month_of(ids[0]) == "2026-03" and month_of(ids[2]) is None
    assert table.pack()
    assert table.archive(ids[:2]) == {ids[0]: "done", ids[1]: "done"}
    assert table.delete(["plain", "gone"]) == {"plain": "done", "gone": "unknown"}
    later = table.record("Data Profiling", "d", "FAIL", DAY)
    for _ in range(2):
        assert {r["run_id"]: r["archived"] for r in table.runs().collect()} == {ids[0]: True, ids[2]: False, later: False}
        assert table.get("plain") is None and table.get(ids[2])["name"] == "c"
        table.pack()  # a merge: the deleted run goes
    assert {r["run_id"] for r in table._runs.read().collect()} == {ids[0], ids[2], later}


def test_writers_and_packers_side_by_side(spark, tmp_path):
    table = RunTable(spark, str(tmp_path))

    def work(i):
        if i % 4 == 3:
            return table.pack() and None
        return table.record("Data Profiling", str(i), "PASS", DAY)

    with ThreadPoolExecutor(4) as pool:
        ids = {i for i in pool.map(work, range(16)) if i}
    table.pack()
    assert sorted(r["run_id"] for r in table.runs().collect()) == sorted(ids) and len(ids) == 12


def test_a_packer_that_comes_second_leaves_nothing(spark, tmp_path, monkeypatch):
    table, plain = RunTable(spark, str(tmp_path)), storage.write_new_text
    run_id = table.record("Data Profiling", "a", "PASS", DAY)

    def overtaken(spark, path, text):
        monkeypatch.setattr(storage, "write_new_text", plain)
        assert table._runs.pack()
        return plain(spark, path, text)

    monkeypatch.setattr(storage, "write_new_text", overtaken)
    assert not table._runs.pack()
    assert [r["run_id"] for r in table.runs().collect()] == [run_id]
    assert len([p for p in (tmp_path / "packed" / "runs").iterdir() if p.name != "lists"]) == 1


def test_a_list_cut_short_does_not_count(spark, tmp_path):
    table = RunTable(spark, str(tmp_path))
    first = table.record("Data Profiling", "a", "PASS", DAY)
    table.pack()
    Path(tmp_path / "packed" / "runs" / "lists" / "00000002.json").write_text('{"packs": [')
    second = table.record("Data Profiling", "b", "PASS", DAY)
    assert {r["run_id"] for r in table.runs().collect()} == {first, second}
    assert table.pack()
    assert {r["run_id"] for r in table.runs().collect()} == {first, second}


@pytest.mark.parametrize("at", [DAY, dt.datetime(1999, 12, 31)])
def test_ids_say_their_month(at):
    assert month_of(new_run_id(at)) == f"{at:%Y-%m}"
