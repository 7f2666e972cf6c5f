"""Referential integrity: child rows whose key names no parent."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions import values as V
from countercheck.functions.names import ColumnError, free_name, ref, require_columns


@dataclass(frozen=True)
class ForeignKey:
    """A declared reference from ``table.columns`` to a parent's columns."""

    name: str
    table: str
    columns: tuple[str, ...]
    referred_table: str
    referred_columns: tuple[str, ...]


def _key_names(child, parent, child_keys, parent_keys) -> tuple[list[str], list[str]]:
    if not child_keys:
        raise ColumnError("At least one child key column is required.")
    if len(child_keys) != len(parent_keys):
        raise ColumnError(
            f"Key columns must pair up: {len(child_keys)} child, {len(parent_keys)} parent"
        )
    ck = require_columns(child_keys, child.columns, "Child column(s)")
    pk = require_columns(parent_keys, parent.columns, "Parent column(s)")
    child_types = {f.name: f.dataType for f in child.schema.fields}
    parent_types = {f.name: f.dataType for f in parent.schema.fields}
    for c, p in zip(ck, pk, strict=True):
        if not V.keys_compatible(child_types[c], parent_types[p]):
            raise ColumnError(f"Key columns '{c}' and '{p}' have unlike types")
    return ck, pk


def _missing(df: DataFrame, keys: list[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = F.lit(False)
    for k in keys:
        missing = missing | V.missing_as_null(ref(k), types[k]).isNull()
    return missing


def _child_key_counts(child, parent, ck, pk) -> DataFrame:
    """One row per distinct child key: ``child_rows`` and whether it is missing
    or an orphan. The child is folded to its keys before anything is joined,
    so a key that most rows share weighs no more than any other."""
    per_key = child.groupBy(*[ref(k).alias(f"k{i}") for i, k in enumerate(ck)]).agg(
        F.count("*").alias("child_rows")
    )
    folded = per_key.withColumn(
        "key_missing", _missing(per_key, [f"k{i}" for i in range(len(ck))])
    )
    parents = parent.select(*[ref(k).alias(f"p{i}") for i, k in enumerate(pk)]).dropna().distinct()
    on = F.lit(True)
    for i in range(len(ck)):
        on = on & (F.col(f"k{i}") == F.col(f"p{i}"))
    return folded.join(parents.withColumn("found", F.lit(True)), on, "left").withColumn(
        "orphan", ~F.col("key_missing") & F.col("found").isNull()
    )


def orphan_summary(
    child: DataFrame,
    parent: DataFrame,
    child_keys: Sequence[str],
    parent_keys: Sequence[str],
    tolerance_percent: float = 0.0,
) -> DataFrame:
    """One row: child rows, rows with a whole key, rows without, orphans. The
    percentage is of the rows with a whole key; the verdict is on the
    unrounded value. A missing key is no reference, not a broken one."""
    ck, pk = _key_names(child, parent, child_keys, parent_keys)
    rows = F.col("child_rows")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    return (
        _child_key_counts(child, parent, ck, pk)
        .agg(
            total(F.lit(True)).alias("child_rows"),
            total(~F.col("key_missing")).alias("checked_rows"),
            total(F.col("key_missing")).alias("null_key_rows"),
            total(F.col("orphan")).alias("orphan_rows"),
            F.count_if("orphan").alias("distinct_orphan_keys"),
        )
        .withColumn("p", V.percent_of(F.col("orphan_rows"), F.col("checked_rows"), 0.0))
        .select(
            "child_rows",
            "checked_rows",
            "null_key_rows",
            "orphan_rows",
            F.round("p", 4).alias("orphan_percent"),
            "distinct_orphan_keys",
            V.verdict(F.col("p") <= tolerance_percent).alias("status"),
        )
    )


def orphans(
    child: DataFrame,
    parent: DataFrame,
    child_keys: Sequence[str],
    parent_keys: Sequence[str],
    sample_limit: int | None = None,
) -> DataFrame:
    """Child rows with a whole key that names no parent.

    Without a limit this is one anti join of plain reads, so that adaptive
    execution splits a key that many child rows share. With a limit, rows come in key order (then all other columns); they belong
    to the first ``limit`` orphan keys at most, so no more keys than that are
    broadcast and the child is not shuffled by row.
    """
    ck, pk = _key_names(child, parent, child_keys, parent_keys)
    whole = child.filter(~_missing(child, ck))
    if sample_limit is None:
        names = [free_name(child.columns, f"parent_key_{i}") for i in range(len(pk))]
        parents = parent.select(*[ref(k).alias(n) for k, n in zip(pk, names, strict=True)]).dropna()
        on = F.lit(True)
        for k, n in zip(ck, names, strict=True):
            on = on & (ref(k) == F.col(n))
        return whole.join(parents, on, "left_anti")
    keyed = _child_key_counts(child, parent, ck, pk).filter(~F.col("key_missing"))
    first = (
        keyed.filter("orphan")
        .select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(ck)])
        .orderBy(*[ref(k) for k in ck])
        .limit(sample_limit)
    )
    rest = [c for c in child.columns if c not in ck]
    return (
        whole.join(F.broadcast(first), on=ck, how="left_semi")
        .select(*[ref(c) for c in child.columns])
        .orderBy(*[ref(c).asc_nulls_last() for c in [*ck, *rest]])
        .limit(sample_limit)
    )


def _common_type(spark, left: T.DataType, right: T.DataType) -> T.DataType:
    """The type in which Spark compares values of two types."""
    both = T.StructType([T.StructField("l", left), T.StructField("r", right)])
    return spark.createDataFrame([], both).select(F.coalesce("l", "r").alias("c")).schema["c"].dataType


def _key_text(value: Column, own: T.DataType, common: T.DataType) -> Column:
    """A text that two values share if and only if they are equal as ``common``."""
    value = V.missing_as_null(value, own).cast(common)
    if isinstance(common, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")  # minus zero is zero
    if isinstance(common, T.BinaryType):
        return F.hex(value)
    if isinstance(common, (T.ArrayType, T.StructType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
    return value.cast("string")


def _sides(number: int, fk: ForeignKey, tables: Mapping[str, DataFrame]) -> Iterator[tuple[str, Column]]:
    """What a row of the child's and of the parent's table says about one key.

    A single whole number is ``number``, any other key ``text``; with a part
    missing, both are null.
    """
    child, parent = tables[fk.table], tables[fk.referred_table]
    names = _key_names(child, parent, fk.columns, fk.referred_columns)
    kinds = [[df.schema[n].dataType for n in own] for df, own in zip((child, parent), names, strict=True)]
    common = [_common_type(child.sparkSession, left, right) for left, right in zip(*kinds, strict=True)]
    whole = len(common) == 1 and isinstance(common[0], T.IntegralType)
    for table, own, types in zip((fk.table, fk.referred_table), names, kinds, strict=True):
        parts = [_key_text(ref(n), t, c) for n, t, c in zip(own, types, common, strict=True)]
        given = functools.reduce(lambda x, y: x & y, (p.isNotNull() for p in parts))
        yield table, F.struct(
            F.lit(number).alias("fk"),
            F.lit(table == fk.table and own is names[0]).alias("is_child"),
            (ref(own[0]) if whole else F.lit(None)).cast("bigint").alias("number"),
            (F.lit(None).cast("string") if whole else F.when(given, parts[0] if len(parts) == 1 else F.to_json(F.array(*parts)))).alias("text"),
        )


def foreign_key_sweep(
    tables: Mapping[str, DataFrame],
    foreign_keys: Iterable[ForeignKey],
    tolerance_percent: float = 0.0,
) -> DataFrame:
    """One orphan summary per declared foreign key, as one DataFrame.

    Every table is read once, whatever the number of keys it is child or parent
    of: each row is spread to (number of the key, side, key value), and all of
    them are folded by key in the map task and meet in one shuffle. A value that
    comes from children only is an orphan, so there is no join, and a value that
    most rows share weighs no more than any other.
    """
    declared = list(foreign_keys)
    if not declared:
        raise ValueError("No foreign keys are declared.")
    said: dict[str, list[Column]] = {}
    for number, fk in enumerate(declared):
        for table, what in _sides(number, fk, tables):
            said.setdefault(table, []).append(what)
    stacked = [tables[t].select(F.explode(F.array(*what)).alias("x")).select("x.*") for t, what in said.items()]
    rows = functools.reduce(DataFrame.unionByName, stacked).filter("is_child or number is not null or text is not null")
    per_key = rows.groupBy("fk", "number", "text").agg(F.count_if("is_child").alias("n"), F.max(~F.col("is_child")).alias("found"))
    n, has_key = F.col("n"), F.col("number").isNotNull() | F.col("text").isNotNull()
    orphan = has_key & ~F.col("found")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    totals = per_key.groupBy("fk").agg(
        F.sum("n").alias("child_rows"),
        total(has_key).alias("checked_rows"),
        total(~has_key).alias("null_key_rows"),
        total(orphan).alias("orphan_rows"),
        F.count_if(orphan).alias("distinct_orphan_keys"),
    )
    spark = tables[declared[0].table].sparkSession
    named = spark.createDataFrame(
        [(i, fk.name, fk.table, fk.referred_table) for i, fk in enumerate(declared)],
        "fk int, foreign_key string, child_table string, parent_table string",
    )
    counted = [c for c in totals.columns if c != "fk"]
    out = named.join(totals, "fk", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counted})
    out = out.withColumn("p", V.percent_of(F.col("orphan_rows"), F.col("checked_rows"), 0.0))
    return out.select(
        "foreign_key",
        "child_table",
        "parent_table",
        "child_rows",
        "checked_rows",
        "null_key_rows",
        "orphan_rows",
        F.round("p", 4).alias("orphan_percent"),
        "distinct_orphan_keys",
        V.verdict(F.col("p") <= tolerance_percent).alias("status"),
    )


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """One row: keys checked and failed, rows checked, orphan rows, verdict."""
    return sweep.agg(
        F.count("*").alias("foreign_keys_checked"),
        F.count_if(F.col("status") == "FAIL").alias("foreign_keys_failed"),
        F.coalesce(F.sum("checked_rows"), F.lit(0)).alias("checked_rows"),
        F.coalesce(F.sum("orphan_rows"), F.lit(0)).alias("orphan_rows"),
    ).withColumn("status", V.verdict(F.col("foreign_keys_failed") == 0))
