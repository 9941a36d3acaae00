"""Sums of measures: normalized values added per kind, which partial aggregation does before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import native as N


def sum_measures(df: DataFrame, keys: list[str | Column], measure: str = "measure") -> DataFrame:
    """keys, kind, and `total` in the friendly unit of each (keys, base unit). A range adds to a range; null measures are passed over."""
    m = F.col(measure)
    base = df.where(m.isNotNull() & m["value"].isNotNull()).select(*keys, N.normalize_measure(measure).alias("__m"))
    names = [c for c in base.columns if c != "__m"]
    sums = base.groupBy(*names, F.col("__m.unit").alias("__unit")).agg(F.sum("__m.value").alias("__low"), F.sum(F.coalesce("__m.upper_value", "__m.value")).alias("__high"), F.max(F.col("__m.upper_value").isNotNull()).alias("__ranged"))
    total = F.struct(F.col("__unit").alias("unit"), F.col("__low").alias("value"), F.when(F.col("__ranged"), F.col("__high")).alias("upper_value"))
    return sums.select(*names, N.unit_kind("__unit").alias("kind"), N.denormalize_measure(total).alias("total"))


def scale_ingredients(df: DataFrame, factor: float | str, column: str = "parsed") -> DataFrame:
    """The table with an INGREDIENT column's amounts scaled as (unit, value, upper_value)."""
    f = F.col(factor) if isinstance(factor, str) else factor
    return df.withColumn(column, F.col(column).withField("amounts", N.scale_amounts(F.col(column)["amounts"], f)))
