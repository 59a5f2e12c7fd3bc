"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where a null key matches a null key; the result keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matches = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, matches, how).drop(*[f"_right_{k}" for k in keys])
