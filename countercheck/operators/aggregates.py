"""Comparison of aggregate values between two sides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countercheck.functions import exact_sum
from countercheck.functions import values as V
from countercheck.functions.names import ColumnError, adopt_spelling, ref, require_columns

# The aggregate functions on offer.
FUNCTIONS = ("COUNT", "COUNT_DISTINCT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class Metric:
    column: str
    function: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}_{self.column}"


def _expression(metric: Metric, value: Column, dtype: T.DataType) -> Column:
    """The aggregate: a double for means and of floats, otherwise a decimal."""
    if metric.function == "COUNT":
        return F.count(value).cast("decimal(38,0)")
    if metric.function == "COUNT_DISTINCT":
        return F.count_distinct(value).cast("decimal(38,0)")
    if isinstance(dtype, T.IntegralType):
        value = value.cast("decimal(28,0)")
    if metric.function == "AVG":
        return F.try_divide(F.sum(value).cast("double"), F.count(value))  # of whole and decimal numbers, see measured
    found = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[metric.function](value)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return found.cast("double")
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    return found.cast(T.DecimalType(38, scale))


def measured(
    df: DataFrame,
    groups: list[str],
    metrics: Sequence[Metric],
    conditions: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Columns m0, m1, ... of one aggregation, beside the groups. ``conditions``
    are counted in the same pass, under their names.

    Sums and means of floats come from totals of bands (``exact_sum``). For them
    each row is read once more per summed column, as band and whole part, and
    folded by band in the map task, before one row a group is made of all.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = require_columns([m.column for m in metrics], df.columns, "Aggregation column(s)")
    for metric, name in zip(metrics, columns, strict=True):
        numeric = V.family(types[name]) in (V.INTEGER, V.FLOAT)
        if not numeric and not metric.function.startswith("COUNT"):
            raise ColumnError(
                f"{metric.function} needs a number, but '{name}' is {types[name].simpleString()}"
            )
    keys = {f"group {i}": V.missing_as_null(ref(g), types[g]) for i, g in enumerate(groups)}
    held = {name: f"value {i}" for i, name in enumerate(dict.fromkeys(columns))}
    values = [V.missing_as_null(ref(name), types[name]).alias(v) for name, v in held.items()]
    flags = {label: f"flag {i}" for i, label in enumerate(conditions or {})}
    flagged = [c.alias(flags[label]) for label, c in (conditions or {}).items()]
    rows = df.select(*[c.alias(k) for k, c in keys.items()], *values, *flagged)

    def is_banded(metric: Metric, name: str) -> bool:
        return metric.function in ("SUM", "AVG") and isinstance(types[name], (T.FloatType, T.DoubleType))

    pairs = list(zip(metrics, columns, strict=True))
    banded = list(dict.fromkeys(held[name] for metric, name in pairs if is_banded(metric, name)))
    plain = {i: (m, n) for i, (m, n) in enumerate(pairs) if not is_banded(m, n)}
    back = [ref(k).alias(g) for k, g in zip(keys, groups, strict=True)]
    if not banded:
        found = [_expression(m, ref(held[n]), types[n]).alias(f"m{i}") for i, (m, n) in plain.items()]
        found += [F.count_if(ref(flag)).alias(label) for label, flag in flags.items()]
        return rows.groupBy(*map(ref, keys)).agg(*found).select(*back, *[f"m{i}" for i in plain], *map(ref, flags))

    nothing = F.lit(None).cast("struct<band: int, part: bigint>")
    kinds = [F.struct(F.lit(-1).alias("of"), nothing.alias("x"))]
    kinds += [F.struct(F.lit(j).alias("of"), exact_sum.band_of(ref(v)).alias("x")) for j, v in enumerate(banded)]
    rows = rows.withColumn("kind", F.explode(F.array(*kinds)))
    of, part = F.col("of"), F.col("part")
    rows = rows.withColumns({"of": F.col("kind.of"), "band": F.col("kind.x.band"), "part": F.col("kind.x.part")})
    found = [_expression(m, F.when(of < 0, ref(held[n])), types[n]).alias(f"m{i}") for i, (m, n) in plain.items()]
    found += [F.count_if((of < 0) & ref(flag)).alias(label) for label, flag in flags.items()]
    by_band = rows.groupBy(*map(ref, keys), "of", "band").agg(
        *found, exact_sum.total_of(part).alias("total"), F.count(part).alias("n")
    )
    whole = [F.max(f"m{i}").alias(f"m{i}") for i in plain]
    whole += [F.coalesce(F.sum(ref(label)), F.lit(0)).alias(label) for label in flags]
    for j, _ in enumerate(banded):
        own = F.when((of == j) & F.col("band").isNotNull(), F.struct("band", "total"))
        whole += [F.collect_list(own).alias(f"bands {j}"), F.sum(F.when(of == j, F.col("n"))).alias(f"n {j}")]
    out = by_band.groupBy(*map(ref, keys)).agg(*whole)
    for j, _ in enumerate(banded):
        out = out.withColumn(f"sum {j}", exact_sum.joined(ref(f"bands {j}")))
    made = []
    for i, (metric, name) in enumerate(pairs):
        if i in plain:
            none = F.lit(0).cast("decimal(38,0)")
            made.append((F.coalesce(f"m{i}", none) if metric.function.startswith("COUNT") else F.col(f"m{i}")).alias(f"m{i}"))
        else:
            j = banded.index(held[name])
            total = ref(f"sum {j}")
            made.append((F.try_divide(total, ref(f"n {j}")) if metric.function == "AVG" else total).alias(f"m{i}"))
    return out.select(*back, *made, *map(ref, flags))


def checked(metrics: Sequence[Metric]) -> Sequence[Metric]:
    """The metrics, if there are any and all of their functions are known."""
    if not metrics:
        raise ValueError("At least one aggregation is required.")
    unknown = [m.function for m in metrics if m.function not in FUNCTIONS]
    if unknown:
        raise ValueError(f"Unknown aggregate function(s): {unknown}")
    return metrics


def aggregate_compare(
    source: DataFrame,
    target: DataFrame,
    metrics: Sequence[Metric],
    group_by: Sequence[str] = (),
    tolerance_percent: float = 0.0,
) -> DataFrame:
    """One row per group and metric with both values and a verdict.

    All metrics of a side come from one aggregation. Only its results, one row
    per group, are then brought together. Missing group values are equal.

    Counts, and sums and extremes of whole and decimal numbers, are compared
    exactly, of any size; values are shown as doubles. Sums of floats are exact
    and then rounded once, so the order of rows doesn't matter and what differs
    by more than a double's last digit differs. A float column beside a decimal
    one has rounded values to begin with: give a tolerance there.
    """
    checked(metrics)
    target = adopt_spelling(target, source)
    groups = require_columns(group_by, source.columns, "Group-by column(s)")
    require_columns(groups, target.columns, "Group-by column(s) in target")

    sides = [measured(frame, groups, metrics) for frame in (source, target)]
    return compare_measured(*sides, metrics, groups, tolerance_percent)


def compare_measured(
    source: DataFrame,
    target: DataFrame,
    metrics: Sequence[Metric],
    groups: Sequence[str] = (),
    tolerance_percent: float = 0.0,
) -> DataFrame:
    """``aggregate_compare`` from what ``measured`` found on either side."""
    sides = [
        frame.select(
            *[ref(g) for g in groups],
            *[F.col(f"m{i}").alias(f"{tag}m{i}") for i in range(len(metrics))],
        )
        for tag, frame in (("s", source), ("t", target))
    ]
    kinds = {f.name: f.dataType for side in sides for f in side.schema.fields}
    together = sides[0].unionByName(sides[1], allowMissingColumns=True)
    both = [f"{t}m{i}" for i in range(len(metrics)) for t in "st"]
    together = together.groupBy(*[ref(g) for g in groups]).agg(*[F.max(c).alias(c) for c in both])

    def compared(i: int, metric: Metric) -> Column:
        own = [kinds[f"{t}m{i}"] for t in "st"]
        common: T.DataType = T.DoubleType()
        if all(isinstance(kind, T.DecimalType) for kind in own):
            common = T.DecimalType(38, max(kind.scale for kind in own))
        s, t = (F.coalesce(F.col(f"{t}m{i}").cast(common), F.lit(0).cast(common)) for t in "st")
        return F.struct(
            F.lit(metric.name).alias("metric"),
            s.cast("double").alias("source_value"),
            t.cast("double").alias("target_value"),
            (t - s).cast("double").alias("difference"),
        )

    per_metric = F.explode(F.array(*[compared(i, m) for i, m in enumerate(metrics)]))
    long = together.select(*[ref(g) for g in groups], per_metric.alias("r")).select(
        *[ref(g) for g in groups], "r.*"
    )
    return (
        long.withColumn("v", V.variance_percent(F.col("source_value"), F.col("difference")))
        .withColumn("variance_percent", F.round("v", 4))
        .withColumn("status", V.verdict(F.col("v") <= tolerance_percent))
        .drop("v")
    )


def aggregate_summary(comparison: DataFrame) -> DataFrame:
    """One row: metrics and rows compared, rows failed, verdict."""
    return comparison.agg(
        F.count_distinct("metric").alias("metrics_compared"),
        F.count("*").alias("rows_compared"),
        F.count_if(F.col("status") == "FAIL").alias("rows_failed"),
    ).withColumn("status", V.verdict(F.col("rows_failed") == 0))
