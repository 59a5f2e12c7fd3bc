"""Dataset profiles: shape, schema, missing values and descriptive statistics.

Each profile is one aggregate over one scan that reads only the profiled columns, then a local
unpivot of its single row. Very wide tables are cut into batches so generated code stays compilable.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.operators.quantiles import ACCURACY, bracket_stats, quantile_name, quantiles_in
from lodeglass.session import materialise

BATCH = 50
SKETCH_ACCURACY = 2_000  # approximate quartiles are off by at most one rank in 2,000
QUARTILES = [0.25, 0.5, 0.75]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.NumericType)


def quoted(name: str) -> Column:
    """A column by its exact name, also when the name contains dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def _one_row_per_column(
    df: DataFrame, columns: list[str], stats: Callable[[Column, T.StructField], dict[str, Column]], batch: int = BATCH
) -> DataFrame:
    if not columns:
        raise ValueError("no column of the kind this profile describes")
    parts = []
    for start in range(0, len(columns), batch):
        names = columns[start : start + batch]
        cells = [
            F.struct(
                F.lit(c).alias("column"), *[v.alias(k) for k, v in stats(quoted(c), df.schema[c]).items()]
            ).alias(f"s{i}")
            for i, c in enumerate(names)
        ]
        row = df.agg(*cells)
        parts.append(row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))]))))
    return union_all(parts)


def _nulls(c: Column) -> Column:
    return F.count_if(c.isNull())


def dataset_shape(datasets: dict[str, DataFrame]) -> DataFrame:
    """dataset, n_rows, n_cols. Parquet answers the count from file footers."""
    return union_all(
        [
            df.agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols")
            )
            for name, df in datasets.items()
        ]
    )


def schema_listing(df: DataFrame, count: bool = False) -> DataFrame:
    """ordinal, column, dtype; with ``count`` also the number of filled cells per column."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes, start=1)]
    listing = df.sparkSession.createDataFrame(rows, "ordinal long, column string, dtype string")
    if not count:
        return listing
    filled = _one_row_per_column(df, df.columns, lambda c, _: {"filled": F.count(c)})
    return listing.join(filled, "column").select("ordinal", "column", "dtype", "filled")


def joined_names(datasets: dict[str, DataFrame]) -> DataFrame:
    """dataset, columns: the column names in order, joined by a comma and a space. No job runs."""
    spark = next(iter(datasets.values())).sparkSession if datasets else SparkSession.active()
    return spark.createDataFrame([(n, ", ".join(df.columns)) for n, df in datasets.items()], "dataset string, columns string")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, null_count, null_pct. NaN is a value, not a missing one."""
    stats = _one_row_per_column(
        df, columns or df.columns, lambda c, _: {"null_count": _nulls(c), "n": F.count(F.lit(1))}
    )
    share = F.try_divide(F.col("null_count") * 100.0, F.col("n"))
    return stats.select("column", "null_count", share.alias("null_pct"))


def quoted_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def value_sql(c: str, kind: T.DataType) -> str:
    """A numeric column as doubles, NaN as null."""
    number = f"cast({c} as double)"
    return f"nanvl({number}, cast(null as double))" if isinstance(kind, (T.DoubleType, T.FloatType)) else number


def numeric_stats(c: str, kind: T.DataType) -> dict[str, str]:
    """SQL aggregates of a numeric column, NaN left out of all but ``count`` and ``nan_count``."""
    value = value_sql(c, kind)
    return {
        "count": f"count({c})",
        "nan_count": f"count_if(isnan(cast({c} as double)))",
        "mean": f"nanvl(avg({value}), cast(null as double))",
        "std": f"nanvl(stddev_samp({value}), cast(null as double))",
        "min": f"min({value})",
        "max": f"max({value})",
    }


def numeric_profile(
    df: DataFrame,
    columns: list[str] | None = None,
    mode: str = "exact",
    accuracy: int | None = None,
) -> DataFrame:
    """column, count, null_count, nan_count, mean, std, min, p25, p50, p75, max, min_exact, max_exact.

    NaN cells are counted and left out of the statistics. Infinite ones take part in the extremes, quartiles and mean; there is
    no spread then, nor a mean of both infinities. The statistics are doubles; ``min_exact`` and ``max_exact`` give the extremes of integer and
    decimal columns in their own type, as text. ``mode='approx'`` needs a single scan, ``mode='exact'`` a second one that counts
    the values close to each quartile.
    """
    names = columns or numeric_columns(df)
    accuracy = accuracy or (SKETCH_ACCURACY if mode == "approx" else ACCURACY)
    quarter = F.array(*[F.lit(q) for q in QUARTILES])

    def stats(c: Column, field: T.StructField) -> dict[str, Column]:
        value = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        own = F.lit(None) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c
        out = {
            **{k: F.expr(v) for k, v in numeric_stats(quoted_sql(field.name), field.dataType).items()},
            "null_count": _nulls(c),
            "min_exact": F.min(own).cast("string"),
            "max_exact": F.max(own).cast("string"),
        }
        if mode == "approx":
            return {**out, "q": F.percentile_approx(value, quarter, accuracy)}
        return {**out, **bracket_stats(value, QUARTILES, accuracy)}

    base = _one_row_per_column(df, names, stats)
    if mode == "approx":
        cuts = [F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    else:
        base = materialise(base)
        values = melt(df, names).where(F.col("value").isNotNull() & ~F.isnan("value"))
        found = quantiles_in(values, ["column"], "value", base, QUARTILES, accuracy).drop("n")
        base = base.join(found, "column", "left")
        cuts = [F.col(quantile_name(p)).alias(n) for p, n in zip(QUARTILES, ("p25", "p50", "p75"))]
    return base.select("column", "count", "null_count", "nan_count", "mean", "std", "min", *cuts, "max", "min_exact", "max_exact")


def melt(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Numeric columns as (column, value) rows; a map-side step that moves no data."""
    keep = keep or []
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*[quoted(k) for k in keep], F.inline(cells))


def n_unique(df: DataFrame, columns: list[str] | None = None, mode: str = "exact") -> DataFrame:
    """column, n_unique; nulls are not counted.

    Exact counts take one scan for all columns of a type; equal cells are merged before they are shuffled.
    """
    names = columns or df.columns
    if mode == "approx":
        return _one_row_per_column(df, names, lambda c, _: {"n_unique": F.approx_count_distinct(c)})
    by_type: dict[str, list[str]] = {}
    for c in names:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    return union_all([_distinct(df, same) for same in by_type.values()])


def _distinct(df: DataFrame, names: list[str]) -> DataFrame:
    """column, n_unique of columns of one type: their cells as rows, made distinct before and after one shuffle."""
    cells = [F.struct(F.lit(i).alias("i"), quoted(c).alias("v")) for i, c in enumerate(names)]
    rows = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
    counted = rows.distinct().groupBy("i").agg(F.count("*").alias("n"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, column string")
    return listed.join(counted, "i", "left").select("column", F.coalesce("n", F.lit(0)).alias("n_unique"))


def string_profile(df: DataFrame, columns: list[str] | None = None, mode: str = "exact") -> DataFrame:
    """column, count, null_count, n_unique, min, max, min_len, max_len."""
    names = columns or columns_of(df, T.StringType)

    def stats(c: Column, _: T.StructField) -> dict[str, Column]:
        size = F.length(c).cast("long")
        out = {
            "count": F.count(c),
            "null_count": _nulls(c),
            "min": F.min(c),
            "max": F.max(c),
            "min_len": F.min(size),
            "max_len": F.max(size),
        }
        if mode == "approx":
            out["n_unique"] = F.approx_count_distinct(c)
        return out

    base = _one_row_per_column(df, names, stats)
    if mode != "approx":
        base = base.join(n_unique(df, names), "column")
    return base.select("column", "count", "null_count", "n_unique", "min", "max", "min_len", "max_len")


def temporal_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, count, null_count, min, max; the bounds as text, since types differ by column."""
    names = columns or columns_of(df, T.DateType, T.TimestampType, T.TimestampNTZType)
    return _one_row_per_column(
        df,
        names,
        lambda c, _: {
            "count": F.count(c),
            "null_count": _nulls(c),
            "min": F.min(c).cast("string"),
            "max": F.max(c).cast("string"),
        },
    )


def boolean_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, count, null_count, true_count, true_share, min, max."""
    names = columns or columns_of(df, T.BooleanType)
    base = _one_row_per_column(
        df,
        names,
        lambda c, _: {
            "count": F.count(c),
            "null_count": _nulls(c),
            "true_count": F.count_if(c),
            "min": F.min(c),
            "max": F.max(c),
        },
    )
    share = F.try_divide(F.col("true_count"), F.col("count"))
    return base.select("column", "count", "null_count", "true_count", share.alias("true_share"), "min", "max")


def text_profile(df: DataFrame, text: str, group: Column) -> DataFrame:
    """group, n_docs, min_len, avg_len, max_len, total_len."""
    size = F.length(quoted(text)).cast("long")
    return df.groupBy(group.alias("group")).agg(
        F.count("*").alias("n_docs"),
        F.min(size).alias("min_len"),
        F.avg(size).alias("avg_len"),
        F.max(size).alias("max_len"),
        F.sum(size).alias("total_len"),
    )
