"""Contiguous balanced shards from global prefix sums.

Rows are range-partitioned in the given order and written once, narrow: keys, size and checksum, never the texts. Each
partition sums its own sizes, the totals of the partitions before it (one row per partition) are added, and a row goes to
the shard in whose equal share of all bytes its middle byte lies. Shards are contiguous in the order and differ from an equal
share by at most one row's size at either cut.

Null text counts as no bytes, so its size is 1. Rows that tie in the order are ordered by size and checksum; rows
equal in all of these are interchangeable. An empty table gives an empty result. Fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.llm.columns import require
from lodeglass.session import materialise


def byte_shards(documents: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, size, text_crc32, position (from 0 in key order), before (bytes ahead of the
    row), shard and slot (position within the shard)."""
    require(documents, key, text)
    if shards < 1:
        raise ValueError("at least one shard")
    narrow = documents.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("_key").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    parts = narrow.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(
        parts.withColumn("_b", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .withColumn("_n", F.count("size").over(upto)),
        "shards",
    )
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_from_byte"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_from_row"),
        F.sum("_size").over(whole).alias("_all"),
    )  # one row per partition: bounded by the partition count, so it may be broadcast
    share = F.expr(f"((2 * before + size) * {int(shards)}L) div (2 * _all)")  # exact up to 2**62 / shards bytes
    sharded = (
        placed.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_from_row") + F.col("_n"))
        .withColumn("before", F.col("_from_byte") + F.col("_b"))
        .withColumn("shard", share.cast("int"))
    )
    first = sharded.groupBy("shard").agg(F.min("position").alias("_first"))  # one row per shard
    return sharded.join(F.broadcast(first), "shard").select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        "position",
        "before",
        "shard",
        (F.col("position") - F.col("_first")).alias("slot"),
    )
