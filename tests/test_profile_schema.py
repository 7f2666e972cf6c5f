import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from countercheck.operators import profile as P
from countercheck.operators import schema_diff as S
from countercheck.plans.checks import Check, run_check
from countercheck.sinks.run_table import RunTable


def customers(spark):
    rows = [
        (i, i * 1.5, None if i == 20 else f"u{i}@x.com", "active" if i <= 15 else "closed")
        for i in range(1, 21)
    ]
    return spark.createDataFrame(rows, "id long, amount double, email string, status string")


@pytest.mark.parametrize("approximate", [False, True])
def test_profile(spark, approximate):
    df = customers(spark).withColumn("amount", F.col("amount") - 1.5)
    rows = {r["column"]: r for r in P.profile(df, approximate_distinct=approximate).collect()}
    assert list(rows) == ["id", "amount", "email", "status"]
    assert (rows["amount"]["min"], rows["amount"]["max"]) == (0.0, 28.5)
    assert rows["amount"]["median"] == statistics.median(i * 1.5 for i in range(20))
    assert rows["amount"]["stddev"] == pytest.approx(statistics.stdev(i * 1.5 for i in range(20)))
    assert (rows["email"]["null_percent"], rows["email"]["semantic_type"]) == (5.0, "EMAIL")
    assert rows["id"]["semantic_type"] == "NUMERIC_ID"
    assert (rows["status"]["semantic_type"], rows["status"]["distinct_count"]) == ("FREE_TEXT", 2)
    assert rows["status"]["median"] is None


def test_top_values(spark):
    rows = [tuple(r) for r in P.top_values(customers(spark), ["STATUS"], 1).collect()]
    assert rows == [("status", "active", 15, 1)]
    tied = spark.createDataFrame([("b",), ("a",), (None,), (None,)], "v string")
    assert [r["value"] for r in P.top_values(tied, top_n=5).orderBy("place").collect()] == ["a", "b"]


def test_top_values_limits_before_the_window_shuffle(spark):
    plan = P.top_values(customers(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(
    ("values", "kind", "expected"),
    [
        ([True, False], "boolean", "BOOLEAN"),
        (["+1 (555) 010-9999"] * 3, "string", "PHONE"),
        ([f"a{i}" for i in range(30)], "string", "IDENTIFIER"),
        ([None, None], "string", "UNKNOWN"),
        ([1.0, 1.0, 2.0], "double", "NUMERIC"),
    ],
)
def test_meaning(spark, values, kind, expected):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    assert P.profile(df).first()["semantic_type"] == expected


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("1d",), ("x",), (" 4 ",)], "v string")
    row = P.profile(df).first()
    assert (row["min"], row["max"], row["median"]) == (1.0, 4.0, 2.5)


def test_empty_table(spark):
    row = P.profile(spark.createDataFrame([], "v double")).first()
    assert (row["distinct_count"], row["null_percent"], row["median"]) == (0, 0.0, None)


@pytest.mark.parametrize("bracket_rows", [10_000_000, 50, 0])
@pytest.mark.parametrize("n", [1, 2, 999, 20_000])
def test_medians_are_exact_at_any_bracket_size(spark, bracket_rows, n):
    rng = random.Random(n)
    data = [
        (rng.gauss(0, 1000), float(rng.choice([3, 3, 3, 4, 9])), None if rng.random() < 0.5 else rng.random())
        for _ in range(n)
    ]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {r["column"]: r["median"] for r in P.exact_medians(df, {c: F.col(c) for c in "abc"}, bracket_rows).collect()}
    for i, c in enumerate("abc"):
        values = [r[i] for r in data if r[i] is not None]
        assert got.get(c) == (pytest.approx(statistics.median(values), rel=1e-14) if values else None)


@pytest.mark.parametrize("bracket_rows", [10_000_000, 3, 0])
def test_medians_of_ties_and_extremes(spark, bracket_rows):
    inf, rng = float("inf"), random.Random(5)
    columns = {
        "two values": [1.0, 2.0] * 500,
        "two far apart": [-1e300, 1e-300] * 500,
        "mostly one": [0.0] * 990 + [rng.random() for _ in range(10)],
        "infinite": [-inf] * 500 + [inf] * 499 + [0.5],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(1000)],
        "all equal": [-3.25] * 1000,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` double" for c in columns))
    got = {r["column"]: r["median"] for r in P.exact_medians(df, {c: F.col(c) for c in columns}, bracket_rows).collect()}
    assert got == {c: pytest.approx(statistics.median(v), rel=1e-14) for c, v in columns.items()}


def test_the_middle_halves_the_doubles_between():
    ends = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf")]
    for i, low in enumerate(ends):
        for high in ends[i + 1 :]:
            rounds, a = 0, low
            while a < high:
                middle = P._middle(a, high)
                assert a < middle <= high
                a, rounds = middle, rounds + 1
            assert rounds <= 65


def test_a_profile_reads_its_table_three_times(spark, tmp_path, monkeypatch):
    rows = [(i, i / 7, f"t{i % 9}") for i in range(500)]
    spark.createDataFrame(rows, "id bigint, x double, t string").write.parquet(str(tmp_path / "t"))
    first, eager = DataFrame.first, []
    monkeypatch.setattr(DataFrame, "first", lambda df: eager.append(df) or first(df))
    profiled = P.profile(spark.read.parquet(str(tmp_path / "t")))
    reads = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (*eager, profiled)]
    assert reads == [1, 2]
    assert {r["column"]: r["median"] for r in profiled.collect()}["x"] == pytest.approx(249.5 / 7)


def schema_status(spark, source, target):
    tables = [{"t": spark.createDataFrame([], s)} for s in (source, target)]
    diff = S.schema_diff(*[S.catalog_of(spark, t) for t in tables])
    return {r["column"]: r["status"] for r in diff.collect()}, S.schema_summary(diff).first()


BASE = "id long, name string, amount double"


@pytest.mark.parametrize(
    ("target", "column", "status", "verdict"),
    [
        (BASE, "name", "MATCH", "PASS"),
        ("ID long, NAME string, Amount double", "amount", "MATCH", "PASS"),
        ("id long, name string", "amount", "MISSING_IN_TARGET", "FAIL"),
        (BASE + ", more int", "more", "EXTRA_IN_TARGET", "FAIL"),
        ("id string, name string, amount double", "id", "TYPE_MISMATCH", "FAIL"),
        ("id int, name string, amount decimal(9,2)", "amount", "MATCH", "PASS"),
        ("name string, id long, amount double", "id", "POSITION_MISMATCH", "PASS"),
    ],
)
def test_schema_diff(spark, target, column, status, verdict):
    statuses, summary = schema_status(spark, BASE, target)
    assert statuses[column] == status and summary["status"] == verdict
    assert list(statuses)[:3] == ["id", "name", "amount"]


def declared(spark, **changes):
    row = {
        "table_name": "t", "column_name": "id", "position": 0, "category": "INTEGER",
        "native_type": "int", "max_length": 10, "nullable": False, "default_value": None,
        "is_primary_key": True, "declared": True,
    } | changes
    return spark.createDataFrame([tuple(row[f.name] for f in S.CATALOG.fields)], S.CATALOG)


def test_attributes(spark):
    same = S.schema_diff(declared(spark), declared(spark)).first()
    assert (same["length_match"], same["key_match"], same["default_match"]) == (True, True, True)
    changed = S.schema_diff(
        declared(spark), declared(spark, max_length=5, is_primary_key=False, default_value="0")
    )
    row = changed.first()
    assert (row["status"], row["length_match"], row["key_match"], row["default_match"]) == (
        "MATCH", False, False, False,
    )
    assert tuple(S.schema_summary(changed).first()) == (1, 0, 1, "FAIL")
    unknown = S.schema_diff(declared(spark), declared(spark, declared=False, max_length=5)).first()
    assert unknown["length_match"] is None


def test_plan_checks(spark):
    catalog = declared(spark).unionByName(
        declared(spark, column_name="note", position=1, nullable=True, is_primary_key=False)
    )
    rows = {(r["table_name"], r["module"]): r for r in S.plan_checks(spark, catalog, ["T", "t", "gone", " "]).collect()}
    assert set(rows) == {("t", m) for m in S.SUPPORTED_CHECKS} | {("gone", None)}
    assert rows["t", "SCHEMA"]["check_columns"] == ["id", "note"]
    assert rows["t", "DUPLICATE"]["key_columns"] == ["id"]
    assert rows["t", "NULLABILITY"]["null_check_columns"] == ["id"]
    assert rows["gone", None]["error"]
    assert S.plan_checks(spark, catalog).count() == 4


def test_one_table_has_one_spelling(spark):
    source = S.catalog_of(spark, {"customer": spark.createDataFrame([], "a int")})
    target = S.catalog_of(spark, {"CUSTOMER": spark.createDataFrame([], "A int, b int"), "New": spark.createDataFrame([], "c int")})
    found = {(r["table_name"], r["column"]): r["status"] for r in S.schema_diff(source, target).collect()}
    assert found == {("customer", "a"): "MATCH", ("customer", "b"): "EXTRA_IN_TARGET", ("New", "c"): "EXTRA_IN_TARGET"}


def test_a_check_sees_declared_lengths(spark, tmp_path):
    for name, width in (("narrow", 10), ("wide", 20)):
        spark.sql(f"CREATE TABLE {name} (id int, v varchar({width})) USING parquet LOCATION '{tmp_path / name}'")
    try:
        runs = RunTable(spark, str(tmp_path / "runs"))
        for columns, target, status in (((), "wide", "FAIL"), ((), "narrow", "PASS"), (("id",), "wide", "PASS"), (("v", "id"), "wide", "FAIL")):
            sides = [{"table": t, "columns": columns} for t in ("narrow", target)]
            outcome = run_check(runs, Check("Schema Validation", *sides))
            assert (outcome.status, outcome.summary["mismatches"]) == (status, 0)
            assert outcome.summary["attribute_mismatches"] == (status == "FAIL")
    finally:
        spark.sql("DROP TABLE narrow")
        spark.sql("DROP TABLE wide")
