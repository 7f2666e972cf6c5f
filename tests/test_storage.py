"""Who owns intermediate tables, and what is left when a check has ended."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from countercheck.plans.checks import Check, run_check
from countercheck.sinks import storage
from countercheck.sinks.reports import number_rows
from countercheck.sinks.run_table import RunTable


def tables(spark):
    folder = Path(storage.shared_folder(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_a_scope_removes_what_no_result_reads(spark):
    before = tables(spark)
    with storage.owned(spark) as outer:
        with storage.owned(spark) as inner:
            a, b, c = (storage.stored(spark.range(n), f"t{n}") for n in (3, 4, 5))
            assert len(tables(spark) - before) == 3
            inner.drop(a)
            result = b.join(spark.range(2), "id").select((F.col("id") + 1).alias("id"))
            inner.keep(result)
        left = tables(spark) - before
        assert len(left) == 1 and left.pop().startswith("t4-")
        assert result.count() == 2
        outer.keep(result)
    assert result.count() == 2 and len(tables(spark) - before) == 1
    del c


def test_a_failing_scope_leaves_nothing(spark):
    before = tables(spark)
    with pytest.raises(RuntimeError), storage.owned(spark):
        storage.stored(spark.range(3), "x")
        raise RuntimeError
    assert tables(spark) == before


def test_an_empty_table_can_be_kept(spark):
    with storage.owned(spark) as scope:
        none = storage.stored(spark.range(0), "none")
        scope.keep(none)
    assert none.count() == 0


def test_a_row_diff_leaves_its_sections_only(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    other = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, name string")
    before, runs = tables(spark), RunTable(spark, str(tmp_path / "runs"))
    outcome = run_check(runs, Check("Full Data Validation", rows, other, {"keys": ["id"]}))
    assert {t: d.count() for t, d in runs.details.load_all(outcome.run_id).items()} == {
        "Mismatches": 1, "Missing in Target": 1, "Extra in Target": 1, "Matched": 1,
    }
    assert outcome.summary["rows_failed"] == 3
    with pytest.raises(ValueError):
        run_check(runs, Check("Full Data Validation", rows.unionAll(rows), other, {"keys": ["id"]}))
    assert tables(spark) == before


def test_numbered_rows_belong_to_a_scope(spark):
    before = tables(spark)
    with storage.owned(spark):
        got = number_rows(spark.range(50).repartition(4), ["id"]).collect()
    assert [(r["id"] + 1) for r in got] == [r["row_number"] for r in got] and tables(spark) == before
