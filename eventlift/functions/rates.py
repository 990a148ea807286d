"""Rates and changes. A zero base gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def percent_change(before: Column, after: Column, digits: int = 2) -> Column:
    change = (after - before).cast("double")
    return F.round(F.try_divide(change, before.cast("double")) * 100, digits)


def money(column: Column, digits: int = 2) -> Column:
    return F.round(column.cast("double"), digits)


def as_doubles(df: DataFrame) -> DataFrame:
    """Decimals stay exact inside the library and become doubles in a report."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
