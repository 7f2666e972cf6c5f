"""Sums of doubles that don't depend on the order of the rows.

A double is a whole number times a power of two. Doubles whose magnitudes lie
within eight powers of two share a band, and in units of that band's smallest
bit they are whole numbers below 2**62. Bands are summed as decimals, exactly
and in any order, and only their totals, at most a few hundred whatever the
number of rows, are joined and rounded once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 8  # powers of two in a band
BITS = 53  # of a double, one more than are below its first: log2 may be off by one at a power of two
INFINITE = 1000  # band of infinity, and its negative that of minus infinity; others are -135 to 127

TOTALS = "array<struct<band: int, total: decimal(38,0)>>"


def band_of(value: Column) -> Column:
    """Struct of ``band`` and ``part``, a bigint in the band's units; null for a null or NaN."""
    x = value.cast("double")
    band = F.floor(F.log2(F.abs(x)) / WIDTH).cast("int")
    half = F.pow(F.lit(2.0), -band * (WIDTH // 2))  # two steps, as 2**-band * WIDTH may be too large for a double
    part = (x * half * half * float(2**BITS)).cast("bigint")
    unit = F.lit(1).cast("bigint")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None))
        .when(x == 0, F.struct(F.lit(0).alias("band"), F.lit(0).cast("bigint").alias("part")))
        .when(F.abs(x) == float("inf"), F.struct((F.signum(x).cast("int") * INFINITE).alias("band"), unit.alias("part")))
        .otherwise(F.struct(band.alias("band"), part.alias("part")))
    )


def total_of(part: Column) -> Column:
    """The aggregate of a band: exact for more rows than there can be."""
    return F.sum(part.cast("decimal(28,0)"))


def join(totals: list[dict] | None) -> float | None:
    """The double nearest to the sum of all bands; None for no band."""
    if not totals:
        return None
    signs = {t["band"] // INFINITE for t in totals if abs(t["band"]) == INFINITE}
    if signs:
        return float("inf") * signs.pop() if len(signs) == 1 else float("nan")
    low = min(t["band"] for t in totals)
    whole = sum(int(t["total"]) << WIDTH * (t["band"] - low) for t in totals)
    shift = WIDTH * low - BITS
    try:
        return float(whole << shift) if shift >= 0 else whole / (1 << -shift)  # both round to the nearest
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def joined(totals: Column) -> Column:
    """``join`` of an array of structs of ``band`` and ``total``: one small array per group."""

    @F.arrow_udf("double")
    def each(values: pa.Array) -> pa.Array:
        return pa.array([join(v.as_py()) for v in values], pa.float64())

    return each(totals.cast(TOTALS))
