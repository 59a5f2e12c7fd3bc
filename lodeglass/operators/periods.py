"""Totals per period and seasonal indices, with gap periods filled.

Rows are first summed to one row per series and period. Windows then run over that calendar, whose
length per series is bounded by the number of periods, never by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.operators.joins import join_on
from lodeglass.session import materialise


UNITS = ("day", "week", "month", "quarter", "year")


def period_totals(df: DataFrame, series: Column, ts: Column, value: Column, unit: str = "month") -> DataFrame:
    """series, period (date), total; periods without rows between first and last have total 0.

    ``unit`` is day, week, month, quarter or year.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is not one of {', '.join(UNITS)}")
    summed = materialise(
        df.where(ts.isNotNull())
        .groupBy(series.alias("series"), F.date_trunc(unit, ts).cast("date").alias("period"))
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    )
    spans = summed.groupBy("series").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    step = F.expr(f"interval 1 {unit}")
    calendar = spans.select("series", F.explode(F.sequence("first", "last", step)).alias("period"))
    return join_on(calendar, summed, ["series", "period"], "left").select(
        "series", "period", F.coalesce("total", F.lit(0.0)).alias("total")
    )


def trend(df: DataFrame, series: Column, ts: Column, value: Column, unit: str = "month") -> DataFrame:
    """series, period, total, prev, change, ma3 (mean of this and the two periods before)."""
    totals = period_totals(df, series, ts, value, unit)
    run = Window.partitionBy("series").orderBy("period")
    prev = F.lag("total").over(run)
    return totals.select(
        "series",
        "period",
        "total",
        prev.alias("prev"),
        (F.col("total") - prev).alias("change"),
        F.avg("total").over(run.rowsBetween(-2, 0)).alias("ma3"),
    )


def seasonal_index(df: DataFrame, series: Column, ts: Column, value: Column) -> DataFrame:
    """series, month, index: a calendar month's mean total over the mean of all months."""
    totals = period_totals(df, series, ts, value, "month")
    monthly = totals.groupBy("series", F.month("period").cast("long").alias("month")).agg(
        F.sum("total").alias("s"), F.count("*").alias("n")
    )
    whole = Window.partitionBy("series")
    mean = F.sum("s").over(whole) / F.sum("n").over(whole)
    index = F.when(mean != 0, F.col("s") / F.col("n") / mean)
    return monthly.select("series", "month", index.alias("index"))
