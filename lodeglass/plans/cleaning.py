"""Ordered cleaning steps with a log, and derived feature columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.text import strip
from lodeglass.operators.profile import melt, quoted, union_all
from lodeglass.operators.quantiles import quantile_name, quantiles_by
from lodeglass.session import materialise

ALIVE, CHANGED = "_alive", "_changed_"


@dataclass(frozen=True)
class Step:
    """One cleaning step. ``kind`` names it; ``options`` depend on the kind.

    trim; null_tokens(tokens); cast(type); fill(with: median, mean, mode or a constant under value);
    drop_null; dedup(order); winsorise(low, high).
    """

    kind: str
    columns: list[str]
    options: dict = field(default_factory=dict)


def _alive(df: DataFrame) -> DataFrame:
    return df.where(F.col(ALIVE))


def _cuts(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Quantiles of several columns at once: one row per column that has any value."""
    rows = quantiles_by(melt(_alive(df), columns), ["column"], "value", probs).collect()
    return {row["column"]: [row[quantile_name(p)] for p in probs] for row in rows}


def _fill_values(df: DataFrame, columns: list[str], how: str) -> dict[str, object]:
    """The filling value per column; a column without any value has none."""
    if how == "median":
        return {c: cut[0] for c, cut in _cuts(df, columns, [0.5]).items()}
    if how == "mean":
        return _alive(df).agg(*[F.avg(F.nanvl(quoted(c).cast("double"), F.lit(None))).alias(c) for c in columns]).first().asDict()
    if how == "mode":
        out = {}
        for c in columns:
            counts = _alive(df).where(quoted(c).isNotNull()).groupBy(quoted(c).alias("v")).agg(F.count("*").alias("n"))
            best = counts.orderBy(F.col("n").desc(), F.col("v")).limit(1).first()
            out[c] = None if best is None else best["v"]
        return out
    raise ValueError(f"unknown fill {how!r}")


def _new_cells(df: DataFrame, step: Step) -> dict[str, Callable[[Column], Column]]:
    """Per column, the expression that replaces a cell."""
    options = step.options
    if step.kind == "trim":
        return dict.fromkeys(step.columns, strip)
    if step.kind == "null_tokens":
        tokens = [t.lower() for t in options["tokens"]]
        return dict.fromkeys(step.columns, lambda c: F.when(~F.lower(strip(c)).isin(tokens), c))
    if step.kind == "cast":
        return dict.fromkeys(step.columns, lambda c: c.try_cast(options["type"]))
    if step.kind == "fill":
        values = (
            dict.fromkeys(step.columns, options["value"])
            if "value" in options
            else _fill_values(df, step.columns, options["with"])
        )
        return {name: _filler(value, df.schema[name].dataType) for name, value in values.items()}
    if step.kind == "winsorise":
        cuts = _cuts(df, step.columns, sorted([options["low"], options["high"]]))
        return {name: _clamp(low, high, df.schema[name].dataType) for name, (low, high) in cuts.items()}
    raise ValueError(f"unknown cleaning step {step.kind!r}")


def _as(value: object, kind: T.DataType) -> Column:
    """A value in a column's type; between two integers it is rounded, halves away from zero."""
    found = F.lit(value)
    return (F.round(found) if isinstance(kind, T.IntegralType) and isinstance(value, float) else found).cast(kind)


def _filler(value: object, kind: T.DataType) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(c, _as(value, kind))


def _clamp(low: float, high: float, kind: T.DataType) -> Callable[[Column], Column]:
    """Values beyond the ends become the ends; null and NaN stay."""
    ends = _as(low, kind), _as(high, kind)

    def clamped(c: Column) -> Column:
        inner = F.when(c.isNotNull(), F.least(F.greatest(c, ends[0]), ends[1]))
        return F.when(F.isnan(c), c).otherwise(inner) if isinstance(kind, T.FractionalType) else inner

    return clamped


def _differs(kind: str, before: Column, after: Column) -> Column:
    """A cast changes the cells it cannot read; every other step those that come out different."""
    same = before.isNull() | after.isNotNull() if kind == "cast" else before.eqNullSafe(after)
    return F.when(same, 0).otherwise(1)


def clean_dataset(df: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, log). The log has step, rows_before, rows_after, cells_changed.

    Cell steps leave a small counter on each row and ``drop_null`` a flag, so that one pass counts
    a whole run of steps; only ``dedup``, which merges rows, closes a run.
    """
    columns = df.columns
    state = df.withColumn(ALIVE, F.lit(True))
    logs: list[DataFrame] = []
    pending: list[Column] = []

    def close(current: DataFrame) -> None:
        if pending:
            row = current.agg(*[c.alias(f"s{i}") for i, c in enumerate(pending)])
            logs.append(row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(pending))]))))
            pending.clear()

    def entry(number: int, step: Step, before: Column, after: Column, cells: Column) -> Column:
        label = f"{number}. {step.kind} {', '.join(step.columns)}"
        return F.struct(
            F.lit(label).alias("step"),
            F.count_if(before).alias("rows_before"),
            F.count_if(after).alias("rows_after"),
            F.coalesce(F.sum(F.when(before, cells)), F.lit(0)).cast("long").alias("cells_changed"),
        )

    for number, step in enumerate(steps, start=1):
        if step.kind == "dedup":
            close(state)
            kept = materialise(_alive(state).select(*columns))
            order = F.struct(*[quoted(c) for c in step.options["order"]])
            # The first row by order, as a minimum: partial results merge, no group is gathered.
            whole = F.struct(*[quoted(c).alias(c) for c in columns])
            merged = kept.groupBy(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(step.columns)]).agg(
                F.min_by(whole, order).alias("row")
            )
            state = materialise(merged.select("row.*")).withColumn(ALIVE, F.lit(True))
            label = f"{number}. dedup {', '.join(step.columns)}"
            counts = kept.agg(F.count("*").alias("rows_before"))
            after = state.agg(F.count("*")).scalar()
            logs.append(
                counts.select(
                    F.lit(label).alias("step"),
                    "rows_before",
                    after.alias("rows_after"),
                    F.lit(0).cast("long").alias("cells_changed"),
                )
            )
            continue
        if step.kind == "drop_null":
            flag = f"_alive_{number}"
            state = state.withColumn(flag, F.col(ALIVE))
            keep = F.col(ALIVE)
            for name in step.columns:
                keep = keep & quoted(name).isNotNull()
            state = state.withColumn(ALIVE, keep).withColumn(f"_kept_{number}", keep)
            pending.append(entry(number, step, F.col(flag), F.col(f"_kept_{number}"), F.lit(0)))
            continue
        cells = _new_cells(state, step)
        renamed = {name: f"_new_{i}" for i, name in enumerate(cells)}
        wide = state.withColumns({new: cells[name](quoted(name)) for name, new in renamed.items()})
        changed = F.lit(0)
        for name, new in renamed.items():
            changed = changed + _differs(step.kind, quoted(name), F.col(new))
        flag = f"_alive_{number}"
        wide = wide.withColumns({f"{CHANGED}{number}": changed, flag: F.col(ALIVE)})
        state = wide.withColumns({name: F.col(new) for name, new in renamed.items()}).drop(*renamed.values())
        pending.append(entry(number, step, F.col(flag), F.col(flag), F.col(f"{CHANGED}{number}")))
    close(state)
    log = union_all(logs) if logs else df.sparkSession.createDataFrame(
        [], "step string, rows_before long, rows_after long, cells_changed long"
    )
    return _alive(state).select(*columns), log


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Adds year, month, day, weekday (1 = Monday) and quarter of a date or timestamp."""
    c = quoted(column)
    return df.withColumns(
        {
            f"{column}_year": F.year(c),
            f"{column}_month": F.month(c),
            f"{column}_day": F.dayofmonth(c),
            f"{column}_weekday": F.weekday(c) + 1,
            f"{column}_quarter": F.quarter(c),
        }
    )


def binned(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """Adds the number of cut points at or below the value; null stays null."""
    at = F.lit(0)
    for cut in sorted(cuts):
        at = at + F.when(quoted(column) >= cut, 1).otherwise(0)
    return df.withColumn(name, F.when(quoted(column).isNotNull(), at))


def ratio(df: DataFrame, numerator: str, denominator: str, name: str) -> DataFrame:
    """Adds a quotient that is null where the denominator is zero."""
    return df.withColumn(name, F.try_divide(quoted(numerator).cast("double"), quoted(denominator).cast("double")))


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """Adds one 0/1 column per listed value; a null or unlisted value gives zeros."""
    return df.withColumns(
        {f"{prefix}{i}": F.when(quoted(column) == v, 1).otherwise(0) for i, v in enumerate(values)}
    )


def feature_columns(
    df: DataFrame,
    dates: list[str] | None = None,
    bins: dict[str, tuple[str, list[float]]] | None = None,
    ratios: dict[str, tuple[str, str]] | None = None,
    flags: dict[str, tuple[str, list[str]]] | None = None,
) -> DataFrame:
    """Source columns plus date parts, bins, ratios and one-hot flags, all within one projection."""
    for column in dates or []:
        df = date_parts(df, column)
    for name, (column, cuts) in (bins or {}).items():
        df = binned(df, column, cuts, name)
    for name, (numerator, denominator) in (ratios or {}).items():
        df = ratio(df, numerator, denominator, name)
    for prefix, (column, values) in (flags or {}).items():
        df = one_hot(df, column, values, prefix)
    return df
