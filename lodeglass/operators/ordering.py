"""Positions and running totals over whole tables, without a single-task window.

A window with no partition key, or with a hot one, sorts its rows in one task. Here the rows are
range-partitioned on the full sort key, so a hot group spreads over many tasks; each partition
numbers its own rows and only one small number per partition is combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.operators.joins import join_on
from lodeglass.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _partition_starts(pieces: DataFrame) -> DataFrame:
    """Total before each partition; one row per partition, bounded by the partition count."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, … over the whole table in the given order.

    The order should be unique for a repeatable numbering.
    """
    ordered = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    starts = _partition_starts(ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size")))
    numbered = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    within = F.col("_id") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return numbered.withColumn(name, F.col("_start") + within).drop("_id", "_part", "_start")


def number_within(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, … inside each group, also when one group holds most rows."""
    numbered = number_rows(df, [*[F.col(g) for g in group], *order], "_at")
    first = materialise(numbered.groupBy(*group).agg(F.min("_at").alias("_first")))
    joined = join_on(numbered, first, group)
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))


def running_total(df: DataFrame, order: list[Column], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` up to and including each row, in the given unique order."""
    ordered = materialise(
        df.orderBy(*order).withColumn("_part", F.spark_partition_id().cast("long"))
    )
    starts = _partition_starts(ordered.groupBy("_part").agg(F.sum(weight).alias("_size")))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ordered.withColumn("_within", F.sum(weight).over(upto))
    joined = summed.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")
