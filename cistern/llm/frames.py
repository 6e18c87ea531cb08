"""Helpers for DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType


def with_fields(df: DataFrame, **kinds: DataType) -> StructType:
    """The schema of df and more fields."""
    return StructType([*df.schema.fields, *(StructField(k, t) for k, t in kinds.items())])
