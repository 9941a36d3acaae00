"""The same operators over streams: parsing is stateless, totals are windowed with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import native as N
from larder.functions import parsing as P


def parse_stream(lines: DataFrame, line: str = "line") -> DataFrame:
    """The stream with `parsed`; no state, so append mode needs no watermark."""
    return lines.withColumn("parsed", P.parse_line(line))


def windowed_totals(parsed: DataFrame, time: str, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, kind, unit, total, n): measures summed in base units per window; rows later than `late` are dropped with the window's state."""
    amounts = parsed.withWatermark(time, late).select(time, F.explode("parsed.amounts").alias("m"))
    base = amounts.select(time, N.normalize_measure(F.struct(*(F.col("m")[k].alias(k) for k in ("unit", "value", "upper_value")))).alias("m"))
    made = base.groupBy(F.window(time, every), F.col("m.unit").alias("unit")).agg(F.sum("m.value").alias("total"), F.count("*").alias("n"))
    return made.select("window", N.unit_kind("unit").alias("kind"), "unit", "total", "n")


def review_stream(parsed: DataFrame) -> DataFrame:
    """Lines that a person should look at, with why."""
    return parsed.withColumn("reasons", N.review_reasons("parsed")).where(F.size("reasons") > 0)
