"""Value rules shared by the operators: types, missing values, equality, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type families used by schema checks and typed equality.
BOOLEAN, INTEGER, FLOAT = "BOOLEAN", "INTEGER", "FLOAT"
DATETIME, STRING, OTHER = "DATETIME", "STRING", "OTHER"

#: Every character that Python's ``str.strip`` removes.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

#: Text that counts as a number. Spark alone would also take '1d' or ' 1f '.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def family(dtype: T.DataType) -> str:
    """Type family of a Spark type. Dates are DATETIME, decimals are FLOAT."""
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.IntegralType):
        return INTEGER
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    return OTHER


def is_binary_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def missing_as_null(value: Column, dtype: T.DataType) -> Column:
    """NaN means missing here, so it becomes NULL before any comparison."""
    return F.nanvl(value, F.lit(None).cast(dtype)) if is_binary_float(dtype) else value


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def fold_case(value: Column) -> Column:
    """Close to Unicode case folding: upper first, so that ß meets ss."""
    return F.lower(F.upper(value))


def as_number(value: Column, dtype: T.DataType) -> Column:
    """The value as a double, NULL where it is not plainly a number."""
    kind = family(dtype)
    if kind in (BOOLEAN, INTEGER, FLOAT):
        return missing_as_null(value.cast("double"), T.DoubleType())
    if kind == STRING:
        number = F.when(value.rlike(NUMBER_PATTERN), value)
        return number.try_cast("double")
    return F.lit(None).cast("double")


def as_text(value: Column, dtype: T.DataType) -> Column:
    """The value as text, with one spelling for both zeroes."""
    if is_binary_float(dtype):
        value = F.when(value == 0, F.lit(0.0).cast(dtype)).otherwise(value)
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def keys_compatible(left: T.DataType, right: T.DataType) -> bool:
    """Can values of these types ever name the same business key?"""
    a, b = family(left), family(right)
    if a == OTHER or b == OTHER:
        return left == right and not isinstance(left, T.MapType)
    numeric = (INTEGER, FLOAT)
    return a == b or (a in numeric and b in numeric)


def values_equal(
    left: Column,
    left_type: T.DataType,
    right: Column,
    right_type: T.DataType,
    nulls_equal: bool = True,
    tolerance: float = 0.0,
) -> Column:
    """Is the pair equal? Never NULL; NaN must already be NULL on both sides.

    The form of the comparison follows from the declared types, so values of
    unlike families are unequal rather than a cast error.
    """
    a, b = family(left_type), family(right_type)
    numeric = (BOOLEAN, INTEGER, FLOAT)
    if a in numeric and b in numeric:
        left = left.cast("int") if a == BOOLEAN else left
        right = right.cast("int") if b == BOOLEAN else right
        a_float, b_float = is_binary_float(left_type), is_binary_float(right_type)
        exact_decimal = isinstance(left_type, T.DecimalType) or isinstance(right_type, T.DecimalType)
        if a_float or b_float:
            left, right = left.cast("double"), right.cast("double")
        same = left == right
        if (a_float or b_float) and tolerance > 0 and not exact_decimal:
            same = same | (F.abs(left - right) <= F.lit(float(tolerance)))
    elif a == b and (a != OTHER or left_type == right_type):
        same = left == right
    else:
        same = F.lit(False)
    one_null = left.isNull() | right.isNull()
    both_null = left.isNull() & right.isNull()
    return F.when(one_null, both_null if nulls_equal else F.lit(False)).otherwise(same)


def percent_of(part: Column, whole: Column, when_empty: float) -> Column:
    """part / whole * 100 as an unrounded double; ``when_empty`` if whole is 0."""
    return F.when(whole == 0, F.lit(when_empty)).otherwise(
        part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0
    )


def variance_percent(base: Column, difference: Column) -> Column:
    """|difference| against |base|, unrounded; an empty base gives 0 or 100."""
    return F.when(
        base == 0, F.when(difference == 0, F.lit(0.0)).otherwise(F.lit(100.0))
    ).otherwise(F.abs(difference).cast("double") / F.nullif(F.abs(base).cast("double"), F.lit(0.0)) * 100.0)


def verdict(passed: Column) -> Column:
    return F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL"))
