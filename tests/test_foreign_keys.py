"""Many foreign keys in one pass against one summary each, and declared keys as a check."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from countercheck.operators import integrity
from countercheck.operators.integrity import ForeignKey
from countercheck.plans.checks import Check, CheckError, run_check
from countercheck.sinks.run_table import RunTable


def tables(spark):
    rnd = random.Random(5)
    nan = float("nan")
    child = [
        (
            rnd.choice([1, 2, 3, 9, None]), rnd.choice(["a", "b", "", " a", None]), rnd.choice([0.0, -0.0, 1.5, nan, None]),
            rnd.choice([True, False, None]), dt.date(2024, 1, rnd.randint(1, 5)), bytearray([rnd.randint(0, 255)]), rnd.choice([1, 2, None]),
        )
        for _ in range(400)
    ]
    parent = [(i, s, x, i > 1, dt.datetime(2024, 1, 1 + i), bytearray([i, 255 - i][:1]), i) for i, s, x in
              [(1, "a", 0.0), (2, "b", 1.5), (3, None, nan), (3, "", 2.5), (None, "a", None)] if i] + [(None, "z", None, None, None, None, None)]
    return {
        "child": spark.createDataFrame(child, "n int, s string, x double, b boolean, d date, y binary, up int"),
        "parent": spark.createDataFrame(parent, "n long, s string, x double, b boolean, d timestamp, y binary, id int"),
    }


KEYS = [
    ForeignKey("whole", "child", ("n",), "parent", ("n",)),
    ForeignKey("text", "child", ("s",), "parent", ("s",)),
    ForeignKey("float", "child", ("x",), "parent", ("x",)),
    ForeignKey("flag", "child", ("b",), "parent", ("b",)),
    ForeignKey("day", "child", ("d",), "parent", ("d",)),
    ForeignKey("bytes", "child", ("y",), "parent", ("y",)),
    ForeignKey("both", "child", ("N", "s"), "parent", ("n", "S")),
    ForeignKey("itself", "child", ("up",), "child", ("n",)),
    ForeignKey("whole", "child", ("n",), "parent", ("id",)),
]


def test_sweep_as_single_summaries(spark):
    sides = tables(spark)
    got = integrity.foreign_key_sweep(sides, KEYS, 30.0).collect()
    assert len(got) == len(KEYS)
    want = []
    for fk in KEYS:
        one = integrity.orphan_summary(sides[fk.table], sides[fk.referred_table], fk.columns, fk.referred_columns, 30.0)
        want.append((fk.name, fk.table, fk.referred_table, *one.first()))
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {r["status"] for r in got} == {"PASS", "FAIL"}
    summary = integrity.sweep_summary(integrity.foreign_key_sweep(sides, KEYS, 30.0)).first()
    assert summary["foreign_keys_checked"] == 9 and summary["orphan_rows"] == sum(r["orphan_rows"] for r in got)


def test_empty_tables(spark):
    sides = tables(spark)
    empty = {"child": sides["child"].limit(0), "parent": sides["parent"]}
    rows = integrity.foreign_key_sweep(empty, KEYS).collect()
    assert len(rows) == len(KEYS) and {(r["child_rows"], r["orphan_percent"], r["status"]) for r in rows} == {(0, 0.0, "PASS")}
    no_parent = {"child": sides["child"], "parent": sides["parent"].limit(0)}
    assert all(r["orphan_rows"] == r["checked_rows"] for r in integrity.foreign_key_sweep(no_parent, KEYS[:7]).collect())


def test_each_table_is_read_once(spark, tmp_path):
    for name, df in tables(spark).items():
        df.write.parquet(str(tmp_path / name))
    sides = {name: spark.read.parquet(str(tmp_path / name)) for name in ("child", "parent")}
    plan = integrity.foreign_key_sweep(sides, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 2
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3


def test_declared_keys_as_a_check(spark, tmp_path):
    sides = tables(spark)
    rows = [(fk.name + str(i), fk.table, c, fk.referred_table, r, p) for i, fk in enumerate(KEYS[:7])
            for p, (c, r) in enumerate(zip(fk.columns, fk.referred_columns, strict=True))]
    rows += [("gone", "child", "n", "elsewhere", "n", 1), ("none", "child", "n", None, None, 1)]
    kind = "constraint_name string, table_name string, column_name string, referred_table string, referred_column string, ordinal_position int"
    declared = spark.createDataFrame(rows, kind)
    runs = RunTable(spark, str(tmp_path / "runs"))
    outcome = run_check(runs, Check("Referential Integrity", None, settings={"foreign_keys": declared, "tables": sides}, name="declared"))
    assert outcome.status == "FAIL" and outcome.summary["foreign_keys_checked"] == 7
    detail = runs.details.load(outcome.run_id, "Foreign Keys")
    assert detail.filter(F.col("foreign_key") == "both6").count() == 1
    with pytest.raises(CheckError):
        run_check(runs, Check("Referential Integrity", None, settings={"foreign_keys": declared.limit(0), "tables": sides}))
    assert runs.runs().filter("status = 'ERROR'").count() == 1
