"""Counts, aggregates, duplicates, completeness and integrity."""

import pytest
from pyspark.sql import functions as F

from countercheck.functions.names import ColumnError
from countercheck.operators import aggregates, completeness, counts, duplicates, integrity
from countercheck.operators.aggregates import Metric


def regions(spark, east, west):
    return spark.createDataFrame(
        [(i, "east") for i in range(east)] + [(i, "west") for i in range(west)],
        "id long, region string",
    )


def test_record_count(spark):
    full, short = regions(spark, 60, 40), regions(spark, 55, 35)
    row = counts.record_count(full, short).first()
    assert tuple(row) == (100, 90, -10, 10.0, "FAIL")
    assert counts.record_count(full, short, tolerance_absolute=10).first()["status"] == "PASS"
    assert counts.record_count(full, short, tolerance_percent=15.0).first()["status"] == "PASS"
    empty = regions(spark, 0, 0)
    assert tuple(counts.record_count(full, empty).first()) == (100, 0, -100, 100.0, "FAIL")
    assert counts.record_count(empty, full).first()["variance_percent"] == 100.0
    assert counts.record_count(empty, empty).first()["status"] == "PASS"


def test_record_count_by_group(spark):
    rows = counts.record_count_by_group(regions(spark, 60, 40), regions(spark, 55, 35), ["REGION"])
    assert [tuple(r) for r in rows.collect()] == [
        ("east", 60, 55, -5, 8.3333), ("west", 40, 35, -5, 12.5),
    ]


def test_missing_groups_do_not_meet(spark):
    s = spark.createDataFrame([("a",), (None,)], "g string")
    rows = counts.record_count_by_group(s, s, ["g"]).collect()
    assert [tuple(r)[:3] for r in rows] == [("a", 1, 1), (None, 1, 0), (None, 0, 1)]


AMOUNTS = "region string, amount double"


def amounts(spark, second):
    return spark.createDataFrame(
        [("east", 100.0), ("east", second), ("west", 50.0), ("west", 50.0)], AMOUNTS
    )


def test_aggregates(spark):
    s = amounts(spark, 200.0)
    row = aggregates.aggregate_compare(s, s, [Metric("AMOUNT", "SUM")]).first()
    assert (row["metric"], row["source_value"], row["status"]) == ("SUM_AMOUNT", 400.0, "PASS")
    changed = aggregates.aggregate_compare(s, amounts(spark, 250.0), [Metric("amount", "SUM")])
    assert (changed.first()["difference"], changed.first()["status"]) == (50.0, "FAIL")
    tolerant = aggregates.aggregate_compare(
        s, amounts(spark, 250.0), [Metric("amount", "SUM")], tolerance_percent=12.5
    )
    assert tolerant.first()["status"] == "PASS"


def test_grouped_aggregates(spark):
    metrics = [Metric("amount", f) for f in aggregates.FUNCTIONS]
    s, t = amounts(spark, 200.0), amounts(spark, 250.0)
    rows = aggregates.aggregate_compare(s, t, metrics, ["region"])
    got = {(r["region"], r["metric"]): (r["source_value"], r["target_value"]) for r in rows.collect()}
    assert got["east", "SUM_amount"] == (300.0, 350.0)
    assert got["west", "COUNT_DISTINCT_amount"] == (1.0, 1.0)
    assert got["east", "AVG_amount"] == (150.0, 175.0)
    summary = aggregates.aggregate_summary(rows).first()
    assert tuple(summary) == (6, 12, 3, "FAIL")


def test_aggregate_group_on_one_side_and_missing_groups(spark):
    s = spark.createDataFrame([("a", 1.0), (None, 2.0)], "g string, v double")
    t = spark.createDataFrame([(None, 2.0), ("z", 0.0)], "G string, V double")
    rows = {r["g"]: r for r in aggregates.aggregate_compare(s, t, [Metric("v", "SUM")], ["g"]).collect()}
    assert rows[None]["status"] == "PASS"
    assert rows["a"]["target_value"] == 0.0 and rows["a"]["variance_percent"] == 100.0
    assert rows["z"]["variance_percent"] == 0.0


def test_aggregates_are_exact_and_steady(spark):
    s, t = (spark.createDataFrame([(v,)], "v long") for v in (9007199254740993, 9007199254740992))
    for function in ("SUM", "MAX"):
        row = aggregates.aggregate_compare(s, t, [Metric("v", function)]).first()
        assert (row["difference"], row["status"]) == (-1.0, "FAIL")
    floats = spark.range(100_000).selectExpr("(id * 7919 % 1000) / 7.0 + id as v")
    metrics = [Metric("v", "SUM"), Metric("v", "AVG")]
    other = floats.repartition(5, F.col("v") * 3)
    assert {r["status"] for r in aggregates.aggregate_compare(floats, other, metrics).collect()} == {"PASS"}
    empty = floats.limit(0)
    assert {r["status"] for r in aggregates.aggregate_compare(empty, empty, metrics).collect()} == {"PASS"}


def test_aggregate_errors(spark):
    s = amounts(spark, 1.0)
    for metrics in ([], [Metric("amount", "MODE")], [Metric("nope", "SUM")], [Metric("region", "SUM")]):
        with pytest.raises(ValueError):
            aggregates.aggregate_compare(s, s, metrics)
    with pytest.raises(ColumnError):
        aggregates.aggregate_compare(s, s, [Metric("amount", "SUM")], ["nope"])


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "e"), (3, "f")], "id int, name string"
    )
    assert tuple(duplicates.duplicate_summary(df, ["ID"]).first()) == (6, 2, 5, 83.3333, "FAIL")
    groups = duplicates.duplicate_groups(df, ["id"]).collect()
    assert sorted(map(tuple, groups)) == [(1, 3), (3, 2)]
    rows = [tuple(r) for r in duplicates.duplicate_rows(df, ["id"]).collect()]
    assert rows == [(1, "a", 3), (1, "b", 3), (1, "c", 3), (3, "e", 2), (3, "f", 2)]
    assert [tuple(r) for r in duplicates.duplicate_rows(df, ["id"], 4).collect()] == rows[:4]
    assert sorted(map(tuple, duplicates.duplicate_rows(df, ["id"], None).collect())) == rows
    assert duplicates.duplicate_summary(df, ["name"]).first()["status"] == "PASS"
    with pytest.raises(ColumnError):
        duplicates.duplicate_groups(df, [])
    with pytest.raises(ColumnError):
        duplicates.duplicate_groups(df, ["nope"])


def test_duplicates_composite_and_missing_keys(spark):
    df = spark.createDataFrame([("east", 1), ("east", 1), ("west", 1)], "region string, id int")
    assert duplicates.duplicate_groups(df, ["region", "id"]).collect() == [("east", 1, 2)]
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "id int")
    assert duplicates.duplicate_summary(nulls, ["id"]).first()["duplicate_row_count"] == 2
    assert duplicates.duplicate_rows(nulls, ["id"]).count() == 0
    assert tuple(duplicates.duplicate_summary(nulls.limit(0), ["id"]).first()) == (0, 0, 0, 0.0, "PASS")


def emails(spark):
    values = [None, "", "N/A"] + [f"u{i}@x.com" for i in range(7)]
    return spark.createDataFrame(list(enumerate(values)), "id long, email string")


def test_completeness(spark):
    stats = completeness.null_stats(emails(spark), ["EMAIL"])
    assert tuple(stats.first()) == ("email", 1, 1, 1, 3, 70.0, 10)
    assert tuple(completeness.null_score(stats).first()) == (10, 70.0, "FAIL")
    assert completeness.null_score(stats, 50.0).first()["status"] == "PASS"
    assert completeness.null_score(completeness.null_stats(emails(spark))).first()[1] == 85.0


def test_completeness_options(spark):
    df = emails(spark)
    custom = completeness.null_stats(df, ["email"], ["N/A", "u0@x.com"]).first()
    assert custom["sentinel_count"] == 2
    assert completeness.null_stats(df, ["email"], []).first()["sentinel_count"] == 0
    empty = completeness.null_stats(df.limit(0))
    assert empty.count() == 0
    assert tuple(completeness.null_score(empty).first()) == (0, 100.0, "PASS")
    with pytest.raises(ColumnError):
        completeness.null_stats(df, ["nope"])


def orders(spark, customers):
    rows = [(i, c, 1.0) for i, c in enumerate(customers)]
    return spark.createDataFrame(rows, "ORDER_ID int, CUSTOMER_ID int, AMOUNT double")


def parents(spark, ids=(10, 20)):
    return spark.createDataFrame([(i,) for i in ids], "customer_id int")


def test_integrity(spark):
    child, parent = orders(spark, [10, 10, 99, 98]), parents(spark, (10, 10, 20))
    args = (child, parent, ["customer_id"], ["CUSTOMER_ID"])
    assert tuple(integrity.orphan_summary(*args).first()) == (4, 4, 0, 2, 50.0, 2, "FAIL")
    assert integrity.orphan_summary(*args, tolerance_percent=50.0).first()["status"] == "PASS"
    assert sorted(r["CUSTOMER_ID"] for r in integrity.orphans(*args).collect()) == [98, 99]
    assert integrity.orphans(*args, sample_limit=1).count() == 1
    assert integrity.orphans(*args, sample_limit=None).count() == 2


def test_integrity_missing_keys(spark):
    child = orders(spark, [10, None, None])
    args = (child, parents(spark), ["CUSTOMER_ID"], ["customer_id"])
    assert tuple(integrity.orphan_summary(*args).first()) == (3, 1, 2, 0, 0.0, 0, "PASS")
    assert integrity.orphans(*args).count() == 0
    only_null = integrity.orphan_summary(orders(spark, [None]), parents(spark), ["CUSTOMER_ID"], ["customer_id"])
    assert tuple(only_null.first()) == (1, 0, 1, 0, 0.0, 0, "PASS")


def test_integrity_composite_and_errors(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "ORDER_ID int, LINE_NO int")
    parent = spark.createDataFrame([(1, 1), (1, 2)], "OID long, LNO int")
    args = (child, parent, ["ORDER_ID", "LINE_NO"], ["OID", "LNO"])
    assert [tuple(r) for r in integrity.orphans(*args).collect()] == [(2, 1)]
    for bad in (([], []), (["ORDER_ID"], ["OID", "LNO"]), (["X"], ["OID"])):
        with pytest.raises(ColumnError):
            integrity.orphan_summary(child, parent, *bad)


def test_a_hot_child_key_is_counted_before_the_join(spark):
    child = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    parent = spark.range(1, 100_000).select(F.col("id").alias("p"))
    summary = integrity.orphan_summary(child, parent.filter("p <> 7"), ["k"], ["p"])
    assert summary.first()["orphan_rows"] == 33_335
    assert summary.first()["distinct_orphan_keys"] == 1


def test_foreign_key_sweep(spark):
    fk = integrity.ForeignKey("fk1", "orders", ("CUSTOMER_ID",), "customers", ("customer_id",))
    tables = {"orders": orders(spark, [10, 99]), "customers": parents(spark)}
    row = integrity.foreign_key_sweep(tables, [fk, fk]).collect()
    assert len(row) == 2 and row[0]["orphan_rows"] == 1 and row[0]["foreign_key"] == "fk1"


@pytest.mark.parametrize(
    ("kind", "values", "sentinels", "expected"),
    [
        ("int", [-999, 5, 0], ["-999", "0", "5.0", "x"], 2),
        ("double", [-999.0, 1.5, 1e10], ["-999", "1.5", "1.0E10"], 2),
        ("boolean", [True, False], ["true"], 1),
        ("string", ["-", "NA ", "NA", "two\nlines"], ["-", "NA", "two\nlines"], 3),
        ("date", ["1900-01-01", "2000-01-01"], ["1900-01-01"], 1),
        ("timestamp_ntz", ["1900-01-01", "2000-01-01"], ["1900-01-01", "2000-01-01 00:00:00"], 1),
        ("decimal(9,2)", ["-999", "1.50"], ["-999", "1.50", "-999.00"], 2),
    ],
)
def test_sentinels_match_the_text_of_any_type(spark, kind, values, sentinels, expected):
    df = spark.createDataFrame([(str(v),) for v in values], "v string")
    df = df.select(F.col("v").cast(kind).alias("v"))
    assert completeness.null_stats(df, ["v"], sentinels).first()["sentinel_count"] == expected
    text = df.filter(F.col("v").cast("string").isin(sentinels)).count()
    assert text == expected


def test_unlimited_lists_keep_hot_keys_out_of_the_shuffle(spark):
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    child = spark.range(30_000).select(hot.alias("k"), F.col("id").alias("orphan"))
    parent = spark.range(5000).select(F.col("id").alias("p"))

    for gone in (7, 8):  # the hot key is an orphan, or a common one is
        listed = integrity.orphans(child, parent.filter(F.col("p") != gone), ["k"], ["p"], None)
        expected = child.filter(F.col("k") == gone)
        assert listed.exceptAll(expected).count() == 0 == expected.exceptAll(listed).count()

    rows = duplicates.duplicate_rows(child, ["k"], None)
    counts = {r["k"]: r["count"] for r in child.groupBy("k").count().collect()}
    got = rows.groupBy("k", "occurrence_count").count().collect()
    assert {r["k"]: r["count"] for r in got} == {k: n for k, n in counts.items() if n > 1}
    assert all(r["occurrence_count"] == r["count"] for r in got)


def test_unlimited_duplicates_split_a_hot_key(spark, tmp_path):
    """Two reads of the table, one to count keys and one to join; adaptive execution splits the key of half the rows."""
    hot = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000)
    spark.range(200_000).select(hot.alias("k"), F.col("id").alias("v")).repartition(8).write.parquet(str(tmp_path / "t"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = duplicates.duplicate_rows(spark.read.parquet(str(tmp_path / "t")), ["k"])
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # the table and its keys
        assert len(rows.collect()) == 200_000
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "N/A")], "`k.id` int, `t.x` string")
    assert duplicates.duplicate_rows(df, ["K.ID"]).count() == 2
    assert duplicates.duplicate_rows(df, ["k.id"], None).count() == 2
    assert {r["column"]: r["sentinel_count"] for r in completeness.null_stats(df).collect()} == {
        "k.id": 0, "t.x": 1,
    }
    parent = spark.createDataFrame([(1,)], "`p.id` int")
    for limit in (10, None):
        assert integrity.orphans(df, parent, ["k.id"], ["p.id"], limit).first()["t.x"] == "N/A"
    assert integrity.orphan_summary(df, parent, ["k.id"], ["p.id"]).first()["orphan_rows"] == 1
    by_group = counts.record_count_by_group(df, df, ["k.id"])
    assert [r["source_count"] for r in by_group.collect()] == [2, 1]
    compared = aggregates.aggregate_compare(df, df, [Metric("k.id", "SUM")], ["t.x"])
    assert compared.filter("status = 'PASS'").count() == 3
