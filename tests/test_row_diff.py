import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from countercheck.functions.names import ColumnError
from countercheck.operators.row_diff import (
    RowDiffOptions,
    count_duplicate_rows,
    row_diff,
)

SCHEMA = "CUST_ID long, NAME string, BALANCE double"
SOURCE = [(1, "Alice", 100.0), (2, "Bob", 200.0), (3, "Carol", 300.0), (4, "Dave", 400.0)]
TARGET = [(1, "Alice", 100.0), (2, "Bobby", 200.0), (3, "Carol", 300.0), (5, "Eve", 500.0)]


def diff(spark, source, target, schema="K long, V double", target_schema=None, keys=("K",), **options):
    return row_diff(
        spark.createDataFrame(source, schema),
        spark.createDataFrame(target, target_schema or schema),
        list(keys),
        RowDiffOptions(**options),
    )


def statuses(result):
    key = result.keys[0]
    return {r[key]: r["diff_status"] for r in result.rows.select(key, "diff_status").collect()}


def test_four_way_split_and_summary(spark):
    result = diff(spark, SOURCE, TARGET, SCHEMA, keys=["CUST_ID"])
    assert statuses(result) == {
        1: "match", 2: "mismatch", 3: "match", 4: "missing_in_target", 5: "extra_in_target",
    }
    assert result.missing().collect() == [(4, "Dave", 400.0)]
    assert result.extra().collect() == [(5, "Eve", 500.0)]
    assert sorted(r["CUST_ID"] for r in result.matched().collect()) == [1, 3]
    wide = result.mismatches().collect()
    assert wide[0].asDict() == {
        "CUST_ID": 2, "NAME_source": "Bob", "NAME_target": "Bobby",
        "BALANCE_source": 200.0, "BALANCE_target": 200.0, "MISMATCHED_COLUMNS": "NAME",
    }
    summary = result.summary().first().asDict()
    assert summary == {
        "rows_source": 4, "rows_target": 4, "rows_compared": 5, "rows_matched": 2,
        "rows_mismatched": 1, "rows_missing_in_target": 1, "rows_extra_in_target": 1,
        "rows_failed": 3, "success_percentage": 40.0, "status": "FAIL",
    }
    assert result.by_column().collect() == [("NAME", 1)]


def test_several_columns_differ(spark):
    result = diff(spark, [(1, 1, 1)], [(1, 2, 2)], "K int, A int, B int")
    assert result.mismatches().first()["MISMATCHED_COLUMNS"] == "A,B"


def test_composite_key(spark):
    rows = [(1, 1, 10), (1, 2, 20), (2, 1, 30)]
    other = [(1, 1, 10), (1, 2, 99), (2, 1, 30)]
    result = diff(spark, rows, other, "K1 int, K2 int, V int", keys=["K1", "K2"])
    s = result.summary().first()
    assert (s["rows_matched"], s["rows_mismatched"]) == (2, 1)


@pytest.mark.parametrize(
    ("s", "t", "options", "expected"),
    [
        (None, None, {}, "match"),
        (float("nan"), None, {}, "match"),
        (None, None, {"nulls_equal": False}, "mismatch"),
        (None, 1.0, {}, "mismatch"),
        (100.004, 100.006, {"float_tolerance": 0.01}, "match"),
        (50.0, 50.5, {"float_tolerance": 0.01}, "mismatch"),
        (float("inf"), float("inf"), {"float_tolerance": 0.01}, "match"),
        (0.0, -0.0, {}, "match"),
    ],
)
def test_null_and_float_rules(spark, s, t, options, expected):
    result = diff(spark, [(1, s)], [(1, t)], **options)
    assert statuses(result) == {1: expected}


@pytest.mark.parametrize(
    ("s_type", "s", "t_type", "t", "options", "expected"),
    [
        ("int", 100, "double", 100.0, {}, "match"),
        ("int", 1, "string", "1", {}, "mismatch"),
        ("boolean", True, "int", 1, {}, "match"),
        ("string", " Ab ", "string", "aB", {"trim_strings": True, "ignore_case": True}, "match"),
        ("string", " x\t", "string", "x", {"trim_strings": True}, "match"),
        ("int", 5, "int", 6, {"float_tolerance": 10.0}, "mismatch"),
        ("date", dt.date(2024, 1, 1), "string", "2024-01-01", {}, "mismatch"),
        ("string", None, "int", None, {}, "match"),
        ("timestamp", dt.datetime(2024, 1, 1), "timestamp", dt.datetime(2024, 1, 2), {}, "mismatch"),
        ("array<int>", [1, 2], "array<int>", [1, 2], {}, "match"),
    ],
)
def test_typed_equality(spark, s_type, s, t_type, t, options, expected):
    result = diff(spark, [(1, s)], [(1, t)], f"K int, V {s_type}", f"K int, V {t_type}", **options)
    assert statuses(result) == {1: expected}


def test_decimal_never_uses_the_tolerance(spark):
    s = spark.sql("select 1 K, cast(1.00 as decimal(10,2)) V")
    t = spark.sql("select 1 K, cast(1.01 as decimal(10,2)) V")
    assert statuses(row_diff(s, t, ["K"], RowDiffOptions(float_tolerance=0.5))) == {1: "mismatch"}


def test_missing_keys_meet(spark):
    result = diff(spark, [(None, 1.0)], [(None, 1.0)])
    assert statuses(result) == {None: "match"}


def test_compare_subset_and_key_only(spark):
    schema = "K int, V int, IGNORED int"
    assert statuses(diff(spark, [(1, 1, 1)], [(1, 1, 2)], schema, compare_columns=["v"])) == {1: "match"}
    assert statuses(diff(spark, [(1,)], [(1,)], "K int")) == {1: "match"}


def test_duplicate_keys(spark):
    rows, other = [(1, 10.0), (1, 20.0), (1, 5.0)], [(1, 5.0)]
    with pytest.raises(Exception, match="Duplicate business key in source"):
        diff(spark, rows, other).summary().collect()
    with pytest.raises(Exception, match="Duplicate business key in target"):
        diff(spark, other, rows).missing().collect()
    with pytest.raises(Exception, match="Duplicate business key in source"):
        diff(spark, [(None, 1.0), (None, 2.0)], other).extra().collect()
    with pytest.raises(Exception, match="Duplicate business key"):
        diff(
            spark, [("a ",), ("A",)], [("a",)], "K string", trim_strings=True, ignore_case=True
        ).summary().collect()
    counted = diff(spark, rows, other, on_duplicate_key="count")
    assert counted.duplicate_rows().first().asDict() == {"source": 2, "target": 0}
    kept = diff(spark, rows, other, on_duplicate_key="keep_first").summary().first()
    assert (kept["rows_compared"], kept["status"]) == (1, "PASS")
    ordered = diff(
        spark, [(1, 2, 9.0), (1, 1, 7.0)], [(1, 1, 7.0)], "K int, O int, V double",
        on_duplicate_key="keep_first", order_by=["o"], compare_columns=["V"],
    )
    assert statuses(ordered) == {1: "match"}
    df = spark.createDataFrame([(None,), (None,), (1,)], "K int")
    assert count_duplicate_rows(df, ["k"]).first()[0] == 1


@pytest.mark.parametrize("view", ["matched", "missing", "extra", "mismatches", "by_column", "summary"])
def test_every_view_refuses_duplicate_keys(spark, view):
    twice = [(1, 1.0), (2, 2.0), (2, 2.0), (3, 3.0)]
    result = diff(spark, twice, [(2, 2.0), (3, 4.0)])
    with pytest.raises(Exception, match="Duplicate business key in source"):
        getattr(result, view)().collect()


def test_one_sided_views_read_only_keys_of_the_other_side(spark, tmp_path):
    for side in ("s", "t"):
        spark.createDataFrame([(1, "a", 1.0)], "K int, A string, B double").write.parquet(str(tmp_path / side))
    s, t = (spark.read.parquet(str(tmp_path / side)) for side in "st")
    plan = row_diff(s, t, ["K"]).missing()._jdf.queryExecution().executedPlan().toString()
    schemas = sorted(line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line)
    assert schemas == ["struct<K:int,A:string,B:double>", "struct<K:int>"]


def test_keep_first_puts_nulls_last(spark):
    result = diff(spark, [(1, None), (1, 3.0)], [(1, 3.0)], on_duplicate_key="keep_first")
    assert statuses(result) == {1: "match"}


def test_key_errors(spark):
    with pytest.raises(ColumnError):
        diff(spark, [(1, 1.0)], [(1, 1.0)], keys=["NOPE"])
    with pytest.raises(ColumnError):
        diff(spark, [(1, 1.0)], [(1, 1.0)], keys=[])
    with pytest.raises(ColumnError, match="unlike types"):
        diff(spark, [(1, 1.0)], [("1", 1.0)], "K int, V double", "K string, V double")
    with pytest.raises(ColumnError):
        diff(spark, [(1, 1.0)], [(1, 1.0)], compare_columns=["X"])


def test_empty_sides(spark):
    s = diff(spark, [], []).summary().first()
    assert (s["rows_compared"], s["success_percentage"], s["status"]) == (0, 100.0, "PASS")


def test_names_differing_by_case(spark):
    result = diff(
        spark, [(1, "a")], [(1, "a")], "CUSTOMER_ID int, Name string", "customer_id int, NAME string",
        keys=["Customer_Id"],
    )
    assert result.keys == ["CUSTOMER_ID"] and result.columns == ["Name"]
    assert statuses(result) == {1: "match"}
    with pytest.raises(ColumnError):
        diff(
            spark, [(1, "a")], [(1, "a")], "CUSTOMER_ID int, N string", "customer_id int, N string",
            keys=["CUSTOMER_ID"], case_insensitive_columns=False,
        )


def test_names_with_dots_and_reserved_names(spark):
    s = spark.createDataFrame([(1, 2, 3)], "in_source int, `a.b` int, __k0 int")
    t = spark.createDataFrame([(1, 2, 4)], "in_source int, `a.b` int, __k0 int")
    for mode in ("error", "keep_first"):
        result = row_diff(s, t, ["in_source"], RowDiffOptions(on_duplicate_key=mode))
        assert result.mismatches().first()["MISMATCHED_COLUMNS"] == "__k0"


def test_generated_200k(spark):
    n = 200_000
    base = spark.range(n).select(
        F.col("id").alias("K"), (F.col("id") * 1.5).alias("V"), F.concat(F.lit("s"), "id").alias("S")
    )
    changed = F.when((F.col("K") >= 100) & (F.col("K") < 150), F.col("V") + 1).otherwise(F.col("V"))
    extra = base.limit(25).withColumn("K", F.col("K") + 10_000_000)
    target = base.filter("K >= 50").withColumn("V", changed).unionByName(extra)
    s = row_diff(base, target, ["K"]).summary().first()
    assert (
        s["rows_missing_in_target"], s["rows_extra_in_target"],
        s["rows_mismatched"], s["rows_matched"],
    ) == (50, 25, 50, n - 100)


@pytest.mark.skipif("RUN_SLOW" not in os.environ, reason="set RUN_SLOW for five million rows a side")
def test_generated_5m(spark):
    base = spark.range(5_000_000).select(
        F.col("id").alias("K"), (F.rand(7) * 1000).alias("AMT"), (F.col("id") * 31 % 97).alias("QTY")
    )
    target = base.withColumn("AMT", F.when(F.col("K") < 1000, F.col("AMT") + 1).otherwise(F.col("AMT")))
    s = row_diff(base, target, ["K"]).summary().first()
    assert (s["rows_mismatched"], s["rows_matched"]) == (1000, 4_999_000)


def test_one_bad_row_in_many_fails(spark):
    rows = spark.range(3_000_000).select(F.col("id").alias("K"))
    s = row_diff(rows, rows.filter("K <> 7"), ["K"]).summary().first()
    assert (s["success_percentage"], s["status"]) == (100.0, "FAIL")


def test_a_hot_key_is_folded_before_the_shuffle(spark):
    hot = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("K"), F.lit(1).alias("V"))
    result = row_diff(hot, hot, ["K"], RowDiffOptions(on_duplicate_key="keep_first"))
    s = result.summary().first()
    assert (s["rows_matched"], s["rows_failed"]) == (200_001, 0)
    plan = result.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_min" in plan and "Join" not in plan


def brute_force(source, target, tolerance, nulls_equal):
    """The four classes from plain dicts, for unique keys."""
    s, t = {r[0]: r[1:] for r in source}, {r[0]: r[1:] for r in target}

    def same(a, b):
        if a is None or b is None:
            return nulls_equal and a is b
        if isinstance(a, float) and tolerance:
            return a == b or abs(a - b) <= tolerance
        return a == b

    out = {}
    for k in s.keys() | t.keys():
        if k not in t:
            out[k] = ("missing_in_target", [])
        elif k not in s:
            out[k] = ("extra_in_target", [])
        else:
            names = [n for n, a, b in zip("ABC", s[k], t[k], strict=True) if not same(a, b)]
            out[k] = ("mismatch" if names else "match", names)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def rows():
        keys = rng.sample([None, *range(60)], 45)
        return [
            (
                k,
                rng.choice([None, 1.0, 1.005, 2.0]),
                rng.choice([None, "x", "X "]),
                rng.choice([None, True, False]),
            )
            for k in keys
        ]

    source, target = rows(), rows()
    tolerance, nulls_equal = rng.choice([0.0, 0.01]), rng.random() < 0.5
    result = diff(
        spark, source, target, "K int, A double, B string, C boolean",
        float_tolerance=tolerance, nulls_equal=nulls_equal,
        on_duplicate_key=rng.choice(["error", "keep_first"]),
    )
    got = {r["K"]: (r["diff_status"], r["mismatched"]) for r in result.rows.collect()}
    assert got == brute_force(source, target, tolerance, nulls_equal)
    s = result.summary().first()
    assert s["rows_compared"] == len(got)
    assert s["rows_source"] == len(source) and s["rows_target"] == len(target)
