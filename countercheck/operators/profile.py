"""Column profiles: counts, numeric statistics, frequent values, meaning."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions import values as V
from countercheck.functions.names import ref, require_columns

# The patterns and shares that decide a column's meaning.
EMAIL_PATTERN = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"(?U)^\+?[\d\-().\s]{7,20}$"
PATTERN_SHARE = 0.8
IDENTIFIER_SHARE = 0.95

#: Size of the quantile sketches. At this size ranks are off by about 0.1% of
#: the rows in one case of a hundred.
SKETCH_SIZE = 4000
#: Ranks to keep on either side of a sketched rank, as a share of the rows:
#: eight standard deviations of the sketch's error.
BRACKET_MARGIN = 0.004
#: Brackets expected to hold more values than this are narrowed again.
BRACKET_ROWS = 10_000_000


def value_counts(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``column, value (as text), frequency`` for every distinct value.

    One shuffle serves all columns. Values are counted per map task first, in
    their own type, so a value that most rows share arrives as one row per
    task, and only distinct values are turned into text.
    """
    names = require_columns(columns, df.columns, "Column(s)") if columns else df.columns
    text = F.coalesce(
        "text",
        F.col("whole").cast("string"),
        F.when(F.col("real") == 0, F.lit("0.0")).otherwise(F.col("real").cast("string")),
        F.col("time").cast("string"),
    )
    return _typed_counts(df, names).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("column"),
        text.alias("value"),
        "frequency",
    )


def _typed_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct values of column number ``i``, in the one of ``whole``,
    ``real``, ``time`` and ``text`` that suits its type, with their counts."""
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds = {"whole": "bigint", "real": "double", "time": "timestamp_ntz", "text": "string"}
    cells = []
    for i, n in enumerate(names):
        value, dtype = V.missing_as_null(ref(n), types[n]), types[n]
        if V.family(dtype) == V.INTEGER:
            used = "whole"
        elif isinstance(dtype, T.DoubleType):
            used = "real"
        elif isinstance(dtype, T.TimestampNTZType):
            used = "time"
        else:
            used, value = "text", V.as_text(value, dtype)
        cells.append(F.lit(i))
        cells += [
            (value if kind == used else F.lit(None)).cast(kinds[kind]) for kind in kinds
        ]
    return (
        df.select(F.stack(F.lit(len(names)), *cells).alias("i", *kinds))
        .groupBy("i", *kinds)
        .agg(F.count("*").alias("frequency"))
    )


def top_values(df: DataFrame, columns: Sequence[str] = (), top_n: int = 5) -> DataFrame:
    """The ``top_n`` most frequent values per column; ties in value order.

    Spark limits each map task to its own ``top_n`` candidates per column
    before the window's shuffle, so the window never sees a whole column.
    """
    best = Window.partitionBy("column").orderBy(F.desc("frequency"), "value")
    return (
        value_counts(df, columns)
        .filter(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= top_n)
    )


def profile(
    df: DataFrame, columns: Sequence[str] = (), approximate_distinct: bool = False
) -> DataFrame:
    """One row per column, in column order.

    The table is read three times: one job collects one row, with the statistics
    of all columns and where their medians are (see ``exact_medians``); exact
    distinct counts and medians are a read each, left to the query that
    consumes the result. Medians of very many rows take further reads.
    """
    names = require_columns(columns, df.columns, "Column(s)") if columns else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers, prepared, aggregates = {}, [], [F.count("*").alias("total_rows")]
    for i, n in enumerate(names):
        value, kind = V.missing_as_null(ref(n), types[n]), V.family(types[n])
        prepared.append(value.alias(f"value{i}"))
        aggregates.append(F.count(f"value{i}").alias(f"filled{i}"))
        if approximate_distinct:
            aggregates.append(F.approx_count_distinct(f"value{i}").alias(f"distinct{i}"))
        if kind in (V.BOOLEAN, V.INTEGER, V.FLOAT, V.STRING):
            numbers[n] = V.as_number(ref(n), types[n])
            prepared.append(numbers[n].alias(f"number{i}"))
            aggregates += [
                F.min(f"number{i}").alias(f"min{i}"),
                F.max(f"number{i}").alias(f"max{i}"),
                F.avg(f"number{i}").alias(f"mean{i}"),
                F.stddev_samp(f"number{i}").alias(f"stddev{i}"),
                *_sketched(F.col(f"number{i}"), i),
            ]
        if kind == V.STRING:
            for name, pattern in (("email", EMAIL_PATTERN), ("phone", PHONE_PATTERN)):
                prepared.append(value.rlike(pattern).cast("double").alias(f"{name}{i}"))
                aggregates.append(F.avg(f"{name}{i}").alias(f"{name}{i}"))
    which = [i for i, n in enumerate(names) if n in numbers]
    one_row = df.select(*prepared).agg(*aggregates)
    kept = [c for c in one_row.columns if not c.startswith("sketch")]
    seen = one_row.select(*kept, *_first_bracket(which)).first().asDict()
    rows = [
        (
            i,
            n,
            types[n].simpleString(),
            V.family(types[n]),
            seen["total_rows"],
            seen.get(f"distinct{i}"),
            *[seen.get(f"{m}{i}") for m in _SEEN],
        )
        for i, n in enumerate(names)
    ]
    stats = df.sparkSession.createDataFrame(
        rows,
        "position int, column string, dtype string, family string, total_rows bigint, "
        "sketched bigint, filled bigint, min double, max double, mean double, stddev double, "
        "email double, phone double",
    )
    if approximate_distinct:
        stats = stats.withColumn("distinct_count", F.col("sketched"))
    else:
        distinct = (
            _typed_counts(df, names)
            .filter("whole is not null or real is not null or time is not null or text is not null")
            .groupBy(F.col("i").alias("position"))
            .agg(F.count("*").alias("distinct_count"))
        )
        stats = stats.join(distinct, "position", "left")
    stats = stats.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    brackets = {names[i]: _bracket(seen, i) for i in which}
    medians = _rank(df, numbers, brackets, BRACKET_ROWS)
    stats = stats.join(medians, "column", "left")
    null_count = F.col("total_rows") - F.col("filled")
    return stats.orderBy("position").select(
        "column",
        "dtype",
        "distinct_count",
        null_count.alias("null_count"),
        F.round(V.percent_of(null_count, F.col("total_rows"), 0.0), 4).alias("null_percent"),
        "min",
        "max",
        "mean",
        "median",
        "stddev",
        _meaning().alias("semantic_type"),
    )


_SEEN = ("filled", "min", "max", "mean", "stddev", "email", "phone")


def _meaning() -> Column:
    mostly_distinct = F.coalesce(
        F.col("distinct_count") > IDENTIFIER_SHARE * F.col("total_rows"), F.lit(False)
    ) & (F.col("total_rows") > 0)
    return (
        F.when(F.col("family") == V.BOOLEAN, "BOOLEAN")
        .when(F.col("family") == V.DATETIME, "DATE")
        .when(F.col("family").isin(V.INTEGER, V.FLOAT) & mostly_distinct, "NUMERIC_ID")
        .when(F.col("family").isin(V.INTEGER, V.FLOAT), "NUMERIC")
        .when(F.col("filled") == 0, "UNKNOWN")
        .when(F.col("email") >= PATTERN_SHARE, "EMAIL")
        .when(F.col("phone") >= PATTERN_SHARE, "PHONE")
        .when(mostly_distinct, "IDENTIFIER")
        .otherwise("FREE_TEXT")
    )


@dataclass
class _Bracket:
    """An interval that holds a column's median; ``low_rank`` and ``high_rank``
    (from 0) are the ranks whose values are averaged. ``expected`` is how many
    distinct values it may hold."""

    low: float | None
    high: float | None
    low_rank: int
    high_rank: int
    expected: float


def exact_medians(
    df: DataFrame, numbers: dict[str, Column], bracket_rows: int = BRACKET_ROWS
) -> DataFrame:
    """``column, median`` over the non-null values of each number column.

    Spark's own ``median`` holds every distinct value of a group in one task.
    Here a quantile sketch of fixed size first brackets the median; then only
    the values inside the bracket are counted and ranked, exactly. A bracket
    that may still hold too many values is narrowed until it doesn't. Each
    sketch is one job with a one-row result; the last step stays lazy. Should a
    sketch ever miss, the result is an error, not a wrong median.
    """
    if not numbers:
        raise ValueError("No number columns.")
    which = range(len(numbers))
    data = df.select(*[v.alias(f"v{i}") for i, v in enumerate(numbers.values())])
    sketched = data.agg(*[a for i in which for a in _sketched(F.col(f"v{i}"), i)])
    seen = sketched.select(*[f"number_count{i}" for i in which], *_first_bracket(which)).first().asDict()
    return _rank(df, numbers, {n: _bracket(seen, i) for i, n in enumerate(numbers)}, bracket_rows)


def _sketched(value: Column, i: int) -> list[Column]:
    return [
        F.count(value).alias(f"number_count{i}"),
        F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE)).alias(f"sketch{i}"),
    ]


def _first_bracket(which) -> list[Column]:
    empty = F.lit(None).cast("double")
    return [
        F.when(
            F.col(f"number_count{i}") > 0,
            F.kll_sketch_get_quantile_double(F.col(f"sketch{i}"), F.lit(0.5 + side)),
        )
        .otherwise(empty)
        .alias(f"{name}{i}")
        for i in which
        for name, side in (("low", -BRACKET_MARGIN), ("high", BRACKET_MARGIN))
    ]


def _bracket(seen: dict, i: int) -> _Bracket:
    n = seen[f"number_count{i}"]
    if not n:
        return _Bracket(None, None, 0, 0, 0.0)
    return _Bracket(seen[f"low{i}"], seen[f"high{i}"], (n - 1) // 2, n // 2, 2 * BRACKET_MARGIN * n)


def _rank(
    df: DataFrame, numbers: dict[str, Column], found: dict[str, _Bracket], bracket_rows: int
) -> DataFrame:
    """Narrow the brackets as far as needed, then rank what is inside them.

    One read: what lies below a bracket is one more group beside the values
    inside it, and comes first in the order of ranks.
    """
    names = [n for n, b in found.items() if b.low is not None]
    brackets = [found[n] for n in names]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, median double")
    data = df.select(*[numbers[n].alias(f"v{i}") for i, n in enumerate(names)])
    while any(b.expected > bracket_rows for b in brackets):
        brackets = _narrow(data, brackets, bracket_rows)

    def cells(i: int) -> list[Column]:
        v, b = F.col(f"v{i}"), brackets[i]
        return [F.lit(i), v < F.lit(b.low), F.when(v.between(F.lit(b.low), F.lit(b.high)), v)]

    ranked = (
        data.select(F.stack(F.lit(len(names)), *[c for i in range(len(names)) for c in cells(i)]).alias("i", "below", "v"))
        .filter("below or v is not null")
        .groupBy("i", "below", "v")
        .agg(F.count("*").alias("n"))
    )
    # The window sees the distinct values inside one bracket, of bounded size.
    up_to_here = (
        Window.partitionBy("i")
        .orderBy(F.desc("below"), "v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def of_column(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("i") + 1)

    def at(ranks: list[int]) -> Column:
        return F.max(F.when(of_column(ranks).between(F.col("upto") - F.col("n"), F.col("upto") - 1), F.col("v")))

    ends = (
        ranked.withColumn("upto", F.sum("n").over(up_to_here))
        .groupBy("i")
        .agg(at([b.low_rank for b in brackets]).alias("low"), at([b.high_rank for b in brackets]).alias("high"))
        .withColumn("column", of_column(names))
    )
    missed = F.raise_error(F.concat(F.lit(MISSED), F.col("column")))
    return ends.select(
        "column",
        F.when(F.col("low").isNull() | F.col("high").isNull(), missed.cast("double"))
        .when(F.col("low") == F.col("high"), F.col("low"))  # two infinities have no difference
        .when(((F.col("low") < 0) & (F.col("high") > 0)) | (F.col("low") == float("-inf")), (F.col("low") + F.col("high")) / 2)
        .otherwise(F.col("low") + (F.col("high") - F.col("low")) / 2)
        .alias("median"),
    )


MISSED = "Median outside its bracket: "

#: Ranks at which a bracket is cut when it is narrowed.
_CUTS = [i / 200 for i in range(1, 200)]


def _narrow(data: DataFrame, brackets: list[_Bracket], bracket_rows: int) -> list[_Bracket]:
    """One job, one row back: a narrower bracket for every column that needs it.

    A sketch of what is inside usually cuts it to a few hundredths. Whatever it
    does, rows are also counted exactly on either side of the middle of the
    interval, and the half without the median goes. Middles halve the doubles
    in between, so 64 rounds end in one value, or in the two that are averaged.
    """
    which = [i for i, b in enumerate(brackets) if b.expected > bracket_rows]
    aggregates = []
    for i in which:
        v, b = F.col(f"v{i}"), brackets[i]
        inside, middle = F.when(v.between(F.lit(b.low), F.lit(b.high)), v), F.lit(_middle(b.low, b.high))
        aggregates += [
            F.count_if(v < F.lit(b.low)).alias(f"below{i}"),
            F.count_if(v < middle).alias(f"left{i}"),
            F.max(F.when(inside < middle, inside)).alias(f"last{i}"),
            F.min(F.when(inside >= middle, inside)).alias(f"next{i}"),
            F.approx_count_distinct(inside).alias(f"distinct{i}"),
            *_sketched(inside, i),
        ]
    cuts = F.array(*[F.lit(c) for c in _CUTS])
    one_row = data.agg(*aggregates)
    kept = [c for c in one_row.columns if not c.startswith("sketch")]
    row = one_row.select(
        *kept, *[F.kll_sketch_get_quantile_double(f"sketch{i}", cuts).alias(f"cuts{i}") for i in which]
    ).first().asDict()
    out = list(brackets)
    for i in which:
        b, n, left = brackets[i], row[f"number_count{i}"], row[f"left{i}"]
        if not row[f"below{i}"] <= b.low_rank <= b.high_rank < row[f"below{i}"] + n:
            raise ValueError(f"{MISSED}ranks {b.low_rank} and {b.high_rank}")
        if b.low_rank < left <= b.high_rank:  # the middle parts the two values that are averaged
            out[i] = _Bracket(row[f"last{i}"], row[f"next{i}"], b.low_rank, b.high_rank, 0.0)
            continue
        low, high = (b.low, row[f"last{i}"]) if b.high_rank < left else (row[f"next{i}"], b.high)
        low_share = (b.low_rank - row[f"below{i}"]) / n - BRACKET_MARGIN
        high_share = (b.high_rank + 1 - row[f"below{i}"]) / n + BRACKET_MARGIN
        under = [k for k, c in enumerate(_CUTS) if c <= low_share]
        over = [k for k, c in enumerate(_CUTS) if c >= high_share]
        low = max(low, row[f"cuts{i}"][under[-1]]) if under else low
        high = min(high, row[f"cuts{i}"][over[0]]) if over else high
        span = (_CUTS[over[0]] if over else 1.0) - (_CUTS[under[-1]] if under else 0.0)
        expected = min(span * n, 1.3 * row[f"distinct{i}"]) if low < high else 0.0
        out[i] = _Bracket(low, high, b.low_rank, b.high_rank, expected)
    return out


def _middle(low: float, high: float) -> float:
    """The double with as many doubles up to ``high`` as down to ``low``, and above ``low``."""

    def place(x: float) -> int:
        bits = int.from_bytes(struct.pack(">d", x))
        return bits if bits < SIGN else SIGN - bits

    middle = -(-(place(low) + place(high)) // 2)
    bits = middle if middle >= 0 else SIGN - middle
    return struct.unpack(">d", bits.to_bytes(8))[0]


SIGN = 1 << 63  # the first bit of a double
