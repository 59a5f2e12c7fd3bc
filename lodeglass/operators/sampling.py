"""First rows, JSON samples and chart samples. Always by key, never by arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISPLAY_ROWS = 10
PROMPT_ROWS = 5


def head_sample(df: DataFrame, order: list[str], n: int = DISPLAY_ROWS) -> DataFrame:
    """The first n rows by key: each task keeps its own n, only those meet."""
    return df.orderBy(*order).limit(n)


def json_sample(df: DataFrame, order: list[str], n: int = PROMPT_ROWS) -> DataFrame:
    """One row: the first n rows as a JSON array of objects, nulls kept."""
    first = head_sample(df, order, n)
    keyed = F.struct(F.struct(*order).alias("key"), F.struct(*df.columns).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(keyed)), lambda r: r["row"])
    return first.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("json"))


def chart_data_bar(df: DataFrame, x: str, y: Column) -> DataFrame:
    """x, y: one aggregated value per category."""
    return df.groupBy(F.col(x).alias("x")).agg(y.alias("y"))


def chart_data_scatter(df: DataFrame, key: str, x: str, y: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """x, y, key of n points chosen by a seeded hash of the key; the same points on every run."""
    return (
        df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
        .limit(n)
        .select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(key).alias("key"))
    )
