"""Profiles of files as they arrive, and event counts by window with closed windows and late rows told apart.

Every batch adds mergeable rows (statistics, counts) to a ``CommitLog``: a replayed batch changes nothing, and reading touches a
number of folders that grows with the logarithm of the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.operators.profile import quoted
from lodeglass.session import materialise
from lodeglass.sinks.commits import FAN, CommitLog, Version

STATS_SCHEMA = (
    "column string, n long, null_count long, mean double, m2 double, min double, max double, "
    "min_exact decimal(38,9), max_exact decimal(38,9), sketch binary"
)
EXACT = T.DecimalType(38, 9)  # holds every integer, and decimals of up to nine places


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream over a Parquet file, folder or pattern."""
    head, _, name = path.rstrip("/").rpartition("/")
    # A pattern, because the source takes a bare path for a folder.
    pattern = path if any(c in path for c in "*?[{") else f"{head}/[{name[0]}]{name[1:]}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def batch_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, null_count, mean, m2, min, max, min_exact, max_exact, sketch: statistics that merge without the rows.

    The sum of squared deviations, not of squares, so large means lose no digits. The exact extremes are those of integer and
    decimal columns, which doubles round.
    """
    cells = []
    for i, name in enumerate(columns):
        v = F.nanvl(quoted(name).cast("double"), F.lit(None).cast("double"))
        rounded = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
        own = F.lit(None).cast(EXACT) if rounded else quoted(name).cast(EXACT)
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(v).alias("n"),
                F.count_if(quoted(name).isNull()).alias("null_count"),
                F.avg(v).alias("mean"),
                (F.var_pop(v) * F.count(v)).alias("m2"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.min(own).alias("min_exact"),
                F.max(own).alias("max_exact"),
                F.hll_sketch_agg(v.cast("string")).alias("sketch"),
            ).alias(f"s{i}")
        )
    return df.agg(*cells).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def _run(stream: DataFrame, state: str, write: Callable[[DataFrame, str], None]) -> None:
    """Process what has arrived and stop. A batch is named by the stream's own state and its number there."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: write(batch, f"{state}#{number}"))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _profile_log(spark: SparkSession, out: str, fan: int = FAN) -> CommitLog:
    return CommitLog(spark, out, {"stats": combine_stats}, fan)


def incremental_profile(stream: DataFrame, columns: list[str], out: str, state: str, fan: int = FAN) -> None:
    """Add the statistics of what has arrived to the profile in ``out``, each batch once."""

    def write(batch: DataFrame, name: str) -> None:
        _profile_log(batch.sparkSession, out, fan).append(name, lambda _: {"stats": batch_stats(batch, columns)})

    _run(stream, state, write)


def read_profile(spark: SparkSession, out: str) -> DataFrame:
    """column, n, null_count, mean, std, min, max, min_exact, max_exact, approx_unique over all batches so far."""
    return merge_stats(_profile_log(spark, out).read("stats", STATS_SCHEMA))


def combine_stats(stats: DataFrame) -> DataFrame:
    """Mergeable statistics, one row per column: deviations within the parts plus those between their means."""
    stats = materialise(stats)
    whole = materialise(
        stats.groupBy("column").agg(
            F.sum("n").alias("n"),
            F.sum("null_count").alias("null_count"),
            F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.min("min_exact").alias("min_exact"),
            F.max("max_exact").alias("max_exact"),
            F.hll_union_agg("sketch").alias("sketch"),
        )
    )
    means = whole.select("column", F.col("mean").alias("_mean"))
    between = F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    spread = stats.join(means, "column").groupBy("column").agg(F.sum(F.col("m2") + between).alias("m2"))
    return whole.join(spread, "column").select(*[f.split(" ")[0] for f in STATS_SCHEMA.split(", ")])


def merge_stats(stats: DataFrame) -> DataFrame:
    """The profile that mergeable statistics add up to."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    unique = F.hll_sketch_estimate("sketch").alias("approx_unique")
    kept = ["min", "max", "min_exact", "max_exact"]
    return combine_stats(stats).select("column", "n", "null_count", "mean", std.alias("std"), *kept, unique)


def utc_instant(ts: Column) -> Column:
    """A zoneless timestamp taken as UTC, whatever the session's zone; watermarks need instants."""
    second = F.extract(F.lit("SECOND"), ts)
    return F.make_timestamp_ltz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), second, F.lit("UTC")
    )


def utc_reading(instant: Column) -> Column:
    """The inverse of ``utc_instant``."""
    seconds = F.unix_micros(instant).cast("decimal(24,0)") / F.lit(1000000).cast("decimal(7,0)")
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def _window_log(spark: SparkSession, out: str, group: str, fan: int = FAN) -> CommitLog:
    def add_up(counts: DataFrame) -> DataFrame:
        return counts.groupBy("start", "end", group).agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))

    return CommitLog(
        spark, out, {"counts": add_up, "clock": lambda c: c.agg(F.max("newest").alias("newest")), "late": lambda rows: rows}, fan
    )


def _newest(log: CommitLog, head: Version | None = None) -> int | None:
    """Microseconds of the newest event so far; one row for each live folder is read."""
    return log.read("clock", "newest long", head).agg(F.max("newest")).first()[0]


def _over(end: Column, delay: str, newest: int | None) -> Column:
    """Whether the newest event is ``delay`` past a window's end; null for rows without a time."""
    if newest is None:
        return F.when(end.isNotNull(), F.lit(False))
    return F.unix_micros(end + F.expr(f"INTERVAL '{delay}'")) <= newest


def windowed_counts(
    stream: DataFrame, ts: str, group: str, out: str, state: str, window: str = "1 day", delay: str = "1 day",
    fan: int = FAN,
) -> DataFrame:
    """Count what has arrived by window and group, and return ``read_windows`` of all that arrived so far.

    Each batch adds its counts; none is dropped, in whatever order files arrive. A row is late if its window was closed by
    the events of earlier batches: it counts, and is kept once more for ``late_rows``.
    """

    def write(batch: DataFrame, name: str) -> None:
        log = _window_log(batch.sparkSession, out, group, fan)
        at = utc_instant(quoted(ts))

        def parts(head: Version) -> dict[str, DataFrame]:
            newest = _newest(log, head)
            timed = batch.withColumn("_at", at)
            framed = timed.withColumn("_window", F.window("_at", window))  # leaves out rows without a time
            late = _over(F.col("_window.end"), delay, newest)
            counted = framed.groupBy(
                F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), quoted(group).alias(group)
            ).agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"), F.max(F.unix_micros("_at")).alias("newest"))
            none = F.lit(None).cast("timestamp")
            untimed = timed.where(F.col("_at").isNull()).groupBy(
                none.alias("start"), none.alias("end"), quoted(group).alias(group)
            ).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_late"), F.lit(None).cast("long").alias("newest"))
            rows = materialise(counted.unionByName(untimed))
            out_ = {"counts": rows.drop("newest"), "clock": rows.agg(F.max("newest").alias("newest"))}
            if not rows.where("n_late > 0").isEmpty():
                out_["late"] = framed.where(late).select(*[quoted(c) for c in batch.columns])
            return out_

        log.append(name, parts)

    _run(stream, state, write)
    return read_windows(stream.sparkSession, out, group, stream.schema[group].dataType, delay)


def read_windows(spark: SparkSession, out: str, group: str, kind: T.DataType, delay: str = "1 day") -> DataFrame:
    """window_start, group column, n, closed: all rows so far; a window is closed once the newest event is ``delay`` past its end.

    Rows without a time count under a null window, which is neither closed nor open.
    """
    log = _window_log(spark, out, group)
    head = log.head()
    schema = T.StructType.fromDDL("start timestamp, end timestamp").add(group, kind).add("n", "long").add("n_late", "long")
    counts = log.read("counts", schema, head).groupBy("start", "end", group).agg(F.sum("n").alias("n"))
    closed = _over(F.col("end"), delay, _newest(log, head)).alias("closed")
    return counts.select(utc_reading(F.col("start")).alias("window_start"), group, "n", closed)


def late_rows(spark: SparkSession, out: str, schema: T.StructType, group: str) -> DataFrame:
    """The rows that arrived after the events of an earlier batch had closed their window, as they came."""
    return _window_log(spark, out, group).read("late", schema)
