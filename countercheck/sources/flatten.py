"""Nested records as flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from countercheck.functions.names import ref


def flatten(df: DataFrame) -> DataFrame:
    """Replace every struct column by its fields, named ``outer.inner``, at any
    depth. Arrays and maps stay as they are."""

    def leaves(value: Column, name: str, dtype: T.DataType) -> list[Column]:
        if not isinstance(dtype, T.StructType):
            return [value.alias(name)]
        return [
            leaf
            for f in dtype.fields
            for leaf in leaves(value.getField(f.name), f"{name}.{f.name}", f.dataType)
        ]

    if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    return df.select([c for f in df.schema.fields for c in leaves(ref(f.name), f.name, f.dataType)])
