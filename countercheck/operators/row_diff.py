"""Row-by-row comparison of a source and a target on business keys.

Both sides are stacked and folded to one row per key, so the whole comparison,
with its check for duplicate keys, is one pass and one shuffle. Rows of a key
are folded in the map task before that shuffle: a key that holds a large share
of the rows (NULL, or a default value) never travels to one task as raw rows.
Missing keys group together by themselves, which is the rule wanted here.

Each side's row is carried as one struct. Folding a struct costs a fraction of
folding its columns one by one, and less than a full outer join preceded by a
check for duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions import values as V
from countercheck.functions.names import (
    ColumnError,
    adopt_spelling,
    free_name,
    ref,
    require_columns,
)

# The four classes of a compared key, and the list column.
MATCH, MISMATCH = "match", "mismatch"
MISSING, EXTRA = "missing_in_target", "extra_in_target"
MISMATCHED_COLUMNS = "MISMATCHED_COLUMNS"
SOURCE_SUFFIX, TARGET_SUFFIX = "_source", "_target"


class DuplicateKeyError(ValueError):
    """Business keys are not unique on one side."""

    def __init__(self, side: str, rows: int) -> None:
        super().__init__(
            f"{side}: {rows} row(s) repeat a business key. Resolve them first, "
            f"or compare with on_duplicate_key='keep_first'."
        )
        self.side = side
        self.rows = rows


@dataclass(frozen=True)
class RowDiffOptions:
    """How rows are compared.

    ``on_duplicate_key``: "error" fails the query that consumes the result,
    "keep_first" keeps one row per key, the first under ``order_by`` (default:
    all other columns, nulls last), "count" leaves the check to the caller,
    who finds it in ``RowDiff.duplicate_rows``.
    """

    compare_columns: Sequence[str] | None = None
    nulls_equal: bool = True
    trim_strings: bool = False
    ignore_case: bool = False
    float_tolerance: float = 0.0
    on_duplicate_key: str = "error"
    order_by: Sequence[str] = field(default_factory=tuple)
    case_insensitive_columns: bool = True


@dataclass(frozen=True)
class RowDiff:
    """One comparison. ``rows`` has one row per key: the keys, ``diff_status``,
    ``<column>_source`` / ``<column>_target`` pairs, ``mismatched`` (an array of
    column names), and how many rows each side has for the key.
    """

    keys: list[str]
    columns: list[str]
    rows: DataFrame
    #: Names in ``rows`` of the counts of source and target rows per key.
    source_rows: str
    target_rows: str
    #: Rows of one side only, read without the other side's values. None if
    #: ``rows`` was written, partitioned by ``diff_status``.
    only_in: Callable[[str], DataFrame] | None = None

    def matched(self) -> DataFrame:
        return self._one_side(MATCH, SOURCE_SUFFIX)

    def missing(self) -> DataFrame:
        return self.only_in("s") if self.only_in else self._one_side(MISSING, SOURCE_SUFFIX)

    def extra(self) -> DataFrame:
        return self.only_in("t") if self.only_in else self._one_side(EXTRA, TARGET_SUFFIX)

    def mismatches(self) -> DataFrame:
        """Keys, value pairs and the comma list of columns that differ."""
        return self.of(MISMATCH).select(
            *[ref(k) for k in self.keys],
            *[ref(c + s) for c in self.columns for s in (SOURCE_SUFFIX, TARGET_SUFFIX)],
            F.concat_ws(",", "mismatched").alias(MISMATCHED_COLUMNS),
        )

    def by_column(self) -> DataFrame:
        """How many mismatched rows each column is part of, most first."""
        return (
            self.of(MISMATCH)
            .select(F.explode("mismatched").alias("column"))
            .groupBy("column")
            .agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), "column")
        )

    def summary(self) -> DataFrame:
        return summarise(self.rows)

    def of(self, status: str) -> DataFrame:
        """Rows of one class, with the columns of ``rows``."""
        return self.rows.filter(F.col("diff_status") == status)

    def duplicate_rows(self) -> DataFrame:
        """One row: how many rows beyond the first per key each side has."""
        return self.rows.agg(
            *[
                F.coalesce(F.sum(F.greatest(F.col(n) - 1, F.lit(0))), F.lit(0)).alias(side)
                for side, n in (("source", self.source_rows), ("target", self.target_rows))
            ]
        )

    def _one_side(self, status: str, suffix: str) -> DataFrame:
        return self.of(status).select(
            *[ref(k) for k in self.keys],
            *[ref(c + suffix).alias(c) for c in self.columns],
        )


def summarise(rows: DataFrame) -> DataFrame:
    """One-row summary of classified rows; only ``diff_status`` is needed.

    The verdict looks at the counts. The percentage is rounded for display, so
    one bad row in ten million shows as 100.0 and still fails.
    """

    def n(*status: str) -> Column:
        return F.count_if(F.col("diff_status").isin(*status))

    counted = rows.agg(
        n(MATCH, MISMATCH, MISSING).alias("rows_source"),
        n(MATCH, MISMATCH, EXTRA).alias("rows_target"),
        F.count("*").alias("rows_compared"),
        n(MATCH).alias("rows_matched"),
        n(MISMATCH).alias("rows_mismatched"),
        n(MISSING).alias("rows_missing_in_target"),
        n(EXTRA).alias("rows_extra_in_target"),
        n(MISMATCH, MISSING, EXTRA).alias("rows_failed"),
    )
    return counted.withColumns(
        {
            "success_percentage": F.round(
                V.percent_of(F.col("rows_matched"), F.col("rows_compared"), 100.0), 4
            ),
            "status": V.verdict(F.col("rows_failed") == 0),
        }
    )


def count_duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first per key. Missing keys equal each other."""
    names = require_columns(keys, df.columns, "Business key(s)")
    per_key = df.groupBy(*[ref(k) for k in names]).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def row_diff(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    options: RowDiffOptions | None = None,
) -> RowDiff:
    """Classify every key as match, mismatch, missing or extra."""
    options = options or RowDiffOptions()
    if not keys:
        raise ColumnError("At least one business key is required.")
    if options.on_duplicate_key not in ("error", "keep_first", "count"):
        raise ValueError(f"Unknown on_duplicate_key: {options.on_duplicate_key!r}")
    keys, columns, source, target = _line_up(source, target, list(keys), options)
    source_types = {f.name: f.dataType for f in source.schema.fields}
    target_types = {f.name: f.dataType for f in target.schema.fields}
    _check_types(keys, columns, source_types, target_types)
    source = source.select([_clean(ref(c), t, options).alias(c) for c, t in source_types.items()])
    target = target.select([_clean(ref(c), t, options).alias(c) for c, t in target_types.items()])

    folded = _fold(source, target, keys, {"s": columns, "t": columns}, options)
    s = {c: F.col("__s")[f"c{i}"] for i, c in enumerate(columns)}
    t = {c: F.col("__t")[f"c{i}"] for i, c in enumerate(columns)}
    equal = {
        c: V.values_equal(
            s[c],
            source_types[c],
            t[c],
            target_types[c],
            options.nulls_equal,
            options.float_tolerance,
        )
        for c in columns
    }
    all_equal = F.lit(True)
    for c in columns:
        all_equal = all_equal & equal[c]
    status = (
        F.when(F.col("__t_rows") == 0, F.lit(MISSING))
        .when(F.col("__s_rows") == 0, F.lit(EXTRA))
        .when(all_equal, F.lit(MATCH))
        .otherwise(F.lit(MISMATCH))
    )
    # Listing columns is the slow part per row, so it is left to rows that need
    # it. Names are distinct, so array_except only takes the NULLs away, and it
    # runs in generated code where array_compact would not.
    nothing = F.array().cast("array<string>")
    null_name = F.array(F.lit(None).cast("string"))
    listed = F.array_except(
        F.array(*[F.when(~equal[c], F.lit(c)) for c in columns]), null_name
    )
    differ = (F.col("__s_rows") > 0) & (F.col("__t_rows") > 0) & ~all_equal
    source_rows = free_name(keys, "source_rows")
    target_rows = free_name([*keys, source_rows], "target_rows")
    rows = folded.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)],
        status.alias("diff_status"),
        *[
            value[c].alias(c + suffix)
            for c in columns
            for value, suffix in ((s, SOURCE_SUFFIX), (t, TARGET_SUFFIX))
        ],
        (F.when(differ, listed).otherwise(nothing) if columns else nothing).alias("mismatched"),
        F.col("__s_rows").alias(source_rows),
        F.col("__t_rows").alias(target_rows),
    )

    def only_in(side: str) -> DataFrame:
        other = "t" if side == "s" else "s"
        return (
            _fold(source, target, keys, {side: columns, other: []}, options)
            .filter(F.col(f"__{other}_rows") == 0)
            .select(
                *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)],
                *[F.col(f"__{side}")[f"c{i}"].alias(c) for i, c in enumerate(columns)],
            )
        )

    return RowDiff(keys, columns, rows, source_rows, target_rows, only_in)


def _fold(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    columns: dict[str, list[str]],
    options: RowDiffOptions,
) -> DataFrame:
    """One row per key: ``__k0..``, each side's row as a struct ``__s`` and
    ``__t`` of its wanted columns (c0..), and how many rows each side has.

    The struct kept is the smallest. With unique keys that is the only one;
    with "keep_first" the columns of the order come first in it, nulls last.
    """
    sides = []
    for tag, frame in (("s", source), ("t", target)):
        parts = []
        if options.on_duplicate_key == "keep_first":
            first = require_columns(options.order_by, frame.columns, "Order column(s)") or [
                f.name
                for f in frame.schema.fields
                if f.name not in keys and not isinstance(f.dataType, T.MapType)
            ]
            for i, c in enumerate(first):
                parts += [ref(c).isNull().alias(f"n{i}"), ref(c).alias(f"o{i}")]
        parts += [ref(c).alias(f"c{i}") for i, c in enumerate(columns[tag])]
        parts.append(F.lit(True).alias("present"))
        sides.append(
            frame.select(
                *[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                F.struct(*parts).alias(f"__{tag}"),
            )
        )
    folded = (
        sides[0]
        .unionByName(sides[1], allowMissingColumns=True)
        .groupBy(*[f"__k{i}" for i in range(len(keys))])
        .agg(
            F.min("__s").alias("__s"),
            F.min("__t").alias("__t"),
            F.count("__s").alias("__s_rows"),
            F.count("__t").alias("__t_rows"),
        )
    )
    if options.on_duplicate_key == "keep_first":
        return folded.withColumns({f"__{t}_rows": F.least(f"__{t}_rows", F.lit(1)) for t in "st"})
    if options.on_duplicate_key == "count":
        return folded
    # Every way to tell the classes apart goes through these counts.
    side = F.when(F.col("__s_rows") > 1, F.lit("source")).otherwise(F.lit("target"))
    key = F.to_json(F.struct(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]))
    message = F.concat(F.lit("Duplicate business key in "), side, F.lit(": "), key)
    unique = (F.col("__s_rows") <= 1) & (F.col("__t_rows") <= 1)
    refused = F.raise_error(message).cast("bigint")
    return folded.withColumns(
        {f"__{t}_rows": F.when(unique, F.col(f"__{t}_rows")).otherwise(refused) for t in "st"}
    )


def _line_up(
    source: DataFrame, target: DataFrame, keys: list[str], options: RowDiffOptions
) -> tuple[list[str], list[str], DataFrame, DataFrame]:
    """Agree on names: source spelling, resolved keys, columns to compare."""
    wanted = options.compare_columns
    if options.case_insensitive_columns:
        target = adopt_spelling(target, source)
        folded = {n.casefold(): n for n in reversed(source.columns)}
        keys = [folded.get(k.casefold(), k) for k in keys]
        if wanted is not None:
            wanted = [folded.get(c.casefold(), c) for c in wanted]
    for side, frame in (("source", source), ("target", target)):
        absent = [k for k in keys if k not in frame.columns]
        if absent:
            raise ColumnError(f"Business key(s) not found in {side}: {absent}")
    if wanted is None:
        columns = [c for c in source.columns if c in set(target.columns) and c not in keys]
    else:
        columns = [c for c in dict.fromkeys(wanted) if c not in keys]
        absent_s = [c for c in columns if c not in source.columns]
        absent_t = [c for c in columns if c not in target.columns]
        if absent_s or absent_t:
            raise ColumnError(
                f"Compare columns not found - source: {absent_s}, target: {absent_t}"
            )
    return list(dict.fromkeys(keys)), columns, source, target


def _check_types(keys, columns, source_types, target_types) -> None:
    for k in keys:
        if not V.keys_compatible(source_types[k], target_types[k]):
            raise ColumnError(
                f"Business key '{k}' has unlike types: {source_types[k].simpleString()} "
                f"in source, {target_types[k].simpleString()} in target"
            )
    for c in columns:
        if isinstance(source_types[c], T.MapType) or isinstance(target_types[c], T.MapType):
            raise ColumnError(f"Column '{c}' is a map; flatten it before comparing")


def _clean(value: Column, dtype: T.DataType, options: RowDiffOptions) -> Column:
    value = V.missing_as_null(value, dtype)
    if V.family(dtype) == V.STRING:
        value = V.strip(value) if options.trim_strings else value
        value = F.upper(value) if options.ignore_case else value
    return value
