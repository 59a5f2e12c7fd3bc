"""What is in these datasets: overview lines and the combined long profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.text import fill_template, snippet
from lodeglass.operators.documents import SPAN, one_after_another
from lodeglass.operators.profile import (
    BATCH,
    QUARTILES,
    SKETCH_ACCURACY,
    columns_of,
    dataset_shape,
    melt,
    n_unique,
    numeric_columns,
    numeric_stats,
    quoted,
    quoted_sql,
    union_all,
    value_sql,
)
from lodeglass.operators.quantiles import quantile_name, quantiles_by
from lodeglass.operators.sampling import json_sample

QUARTILE_NAMES = ["p25", "p50", "p75"]
# Headings and sentence of the rendered summary.
TABLE_HEADING = "\n## Profile: "
TEXT_HEADING = "\n## Text Document: "
NO_SUMMARY = "No detailed data profiles or text snippets available."

LONG_COLUMNS = ["dataset", "kind", "column", "stat", "value_num", "value_str"]


def dataset_overview(datasets: dict[str, DataFrame], texts: DataFrame | None = None) -> DataFrame:
    """dataset, line. ``texts`` needs a ``name`` column."""
    lines = dataset_shape(datasets).select(
        "dataset", F.format_string("- Tabular: %s (%d rows, %d cols)", "dataset", "n_rows", "n_cols").alias("line")
    )
    if texts is None:
        return lines
    named = texts.select(F.col("name").alias("dataset"), F.concat(F.lit("- Text: "), "name").alias("line"))
    return lines.unionByName(named)


Cell = tuple[str, str | None, str, str | None, str | None]  # kind, column, statistic, SQL of its number or text


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cell(kind: str, column: str | None, stat: str, number: str | None, text: str | None) -> str:
    """One row of the long form, as SQL: thousands of these are made for a wide table, and column objects are slow to make."""
    named = f"cast({column or 'null'} as string)"
    return (
        f"named_struct('kind', {_text(kind)}, 'column', {named}, 'stat', {_text(stat)}, "
        f"'value_num', cast({number or 'null'} as double), 'value_str', cast({text or 'null'} as string))"
    )


def _cells_of(field: T.StructField, ordinal: int, mode: str) -> tuple[dict[str, str], list[Cell]]:
    """The aggregates of one column, and the statistics made of their results."""
    c, kind, name = quoted_sql(field.name), field.dataType, _text(field.name)
    stats = {"count": f"count({c})"}
    numbers, texts, label = ["count"], [], ""
    if isinstance(kind, T.NumericType):
        label, stats = "numeric", numeric_stats(c, kind)
        numbers = list(stats)
        if mode == "approx":
            quarters = ", ".join(f"{q}D" for q in QUARTILES)
            stats["q"] = f"percentile_approx({value_sql(c, kind)}, array({quarters}), {SKETCH_ACCURACY})"
    elif isinstance(kind, T.StringType):
        label, numbers, texts = "string", ["count", "min_len", "max_len"], ["min", "max"]
        stats |= {"min": f"min({c})", "max": f"max({c})", "min_len": f"min(length({c}))", "max_len": f"max(length({c}))"}
        if mode == "approx":
            stats["n_unique"] = f"approx_count_distinct({c})"
            numbers.append("n_unique")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        label, texts = "temporal", ["min", "max"]
        stats |= {"min": f"min({c})", "max": f"max({c})"}
    elif isinstance(kind, T.BooleanType):
        label, numbers = "boolean", ["count", "true_count"]
        stats["true_count"] = f"count_if({c})"
    else:
        numbers = []
    nulls = f"(_n - count_{ordinal})"
    cells: list[Cell] = [
        ("schema", name, "ordinal", str(ordinal), None),
        ("schema", name, "dtype", None, _text(kind.simpleString())),
        ("missing", name, "null_count", nulls, None),
        ("missing", name, "null_pct", f"try_divide({nulls} * 100.0D, _n)", None),
        *[(label, name, s, f"{s}_{ordinal}", None) for s in numbers],
        *[(label, name, s, None, f"{s}_{ordinal}") for s in texts],
    ]
    if "q" in stats:
        cells += [(label, name, s, f"get(q_{ordinal}, {i})", None) for i, s in enumerate(QUARTILE_NAMES)]
    if label == "boolean":
        cells.append((label, name, "true_share", f"try_divide(true_count_{ordinal}, count_{ordinal})", None))
    return {f"{k}_{ordinal}": v for k, v in stats.items()}, cells


def profile_long(df: DataFrame, dataset: str, mode: str = "approx", batch: int = BATCH) -> DataFrame:
    """One dataset's shape, schema, missing values and statistics by column type, in long form.

    All of it is one aggregate over one scan for up to ``batch`` columns. ``mode="exact"`` adds the scans of exact quartiles and of exact
    distinct counts of texts.
    """
    parts = []
    fields = list(enumerate(df.schema.fields, 1))
    for start in range(0, max(len(fields), 1), batch):
        aggregates, cells = {"_n": "count(1)"}, []
        if start == 0:
            cells = [("shape", None, "n_rows", "_n", None), ("shape", None, "n_cols", str(len(fields)), None)]
        for ordinal, field in fields[start : start + batch]:
            named, more = _cells_of(field, ordinal, mode)
            aggregates |= named
            cells += more
        row = df.selectExpr(*[f"{v} AS {k}" for k, v in aggregates.items()])
        parts.append(row.selectExpr(f"inline(array({', '.join(_cell(*c) for c in cells)}))"))
    if mode != "approx":
        if names := numeric_columns(df):
            cuts = quantiles_by(melt(df, names), ["column"], "value", QUARTILES, keep_empty=True)
            found = [_cell("numeric", "`column`", s, quantile_name(p), None) for p, s in zip(QUARTILES, QUARTILE_NAMES, strict=True)]
            parts.append(cuts.selectExpr(f"inline(array({', '.join(found)}))"))
        if names := columns_of(df, T.StringType):
            unique = _cell("string", "`column`", "n_unique", "n_unique", None)
            parts.append(n_unique(df, names).selectExpr(f"inline(array({unique}))"))
    return union_all(parts).select(F.lit(dataset).alias("dataset"), *LONG_COLUMNS[1:])


def texts_long(texts: DataFrame, name: Column, text: str, size: int = 200) -> DataFrame:
    """Length and snippet of each document in the same long form."""
    cells = F.array(
        F.struct(
            F.lit("text_length").alias("stat"),
            F.length(text).cast("double").alias("value_num"),
            F.lit(None).cast("string").alias("value_str"),
        ),
        F.struct(
            F.lit("snippet").alias("stat"),
            F.lit(None).cast("double").alias("value_num"),
            snippet(F.col(text), size).alias("value_str"),
        ),
    )
    return texts.select(
        name.alias("dataset"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("column"), F.inline(cells)
    ).select(*LONG_COLUMNS)


def combined_profile(
    datasets: dict[str, DataFrame], texts: DataFrame | None = None, mode: str = "approx"
) -> DataFrame:
    """dataset, kind, column, stat, value_num, value_str of all datasets and documents.

    ``texts`` is the result of ``texts_long``.
    """
    parts = [profile_long(df, name, mode) for name, df in datasets.items()]
    if texts is not None:
        parts.append(texts)
    return union_all(parts)


def table_sections(profile: DataFrame) -> DataFrame:
    """dataset, block: each dataset of a long profile as text: shape, column names, and a line per column."""

    def pick(kind: str, stat: str, value: str) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("stat") == stat), F.col(value)))

    per_column = profile.where(F.col("column").isNotNull()).groupBy("dataset", "column").agg(
        pick("schema", "ordinal", "value_num").cast("int").alias("ordinal"),
        pick("schema", "dtype", "value_str").alias("dtype"),
        pick("missing", "null_count", "value_num").cast("long").alias("nulls"),
        *[pick("numeric", s, "value_num").alias(s) for s in ("mean", "min", "max")],
    )
    numbers = F.format_string("; mean %.4f, min %.4f, max %.4f", "mean", "min", "max")
    line = F.concat(
        F.format_string("- %s (%s): %d missing", "column", "dtype", "nulls"),
        F.when(F.col("mean").isNotNull(), numbers).otherwise(""),
    )
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column", line.alias("line"))))  # as many as there are columns
    columns = per_column.groupBy("dataset").agg(listed.alias("listed"))
    shapes = profile.where("kind = 'shape'").groupBy("dataset").agg(
        *[pick("shape", s, "value_num").cast("long").alias(s) for s in ("n_rows", "n_cols")]
    )
    block = F.concat(
        F.lit(TABLE_HEADING),
        "dataset",
        F.format_string("\nShape: (%d, %d)\nColumns: ", "n_rows", "n_cols"),
        F.array_join(F.transform("listed", lambda c: c["column"]), ", "),
        F.lit("\n"),
        F.array_join(F.transform("listed", lambda c: F.concat(c["line"], F.lit("\n"))), ""),
    )
    return shapes.join(columns, "dataset", "left").select("dataset", F.coalesce(block, F.lit("")).alias("block"))


def text_sections(texts: DataFrame, name: Column, text: str, position: Column, size: int = 200) -> DataFrame:
    """position, block: each document with a snippet."""
    block = F.concat(F.lit(TEXT_HEADING), name, F.lit("\nSnippet: "), snippet(F.col(text), size), F.lit("\n"))
    return texts.select(position.alias("position"), block.alias("block"))


def profile_summary(
    datasets: dict[str, DataFrame], texts: DataFrame | None = None, mode: str = "approx", span: int | None = SPAN
) -> DataFrame:
    """kind, part, summary: what a prompt says about the data, tables (kind 0) before documents (kind 1).

    ``texts`` is the result of ``text_sections``. Without any dataset or document the summary is one fixed sentence.
    """
    kinds = []
    if datasets:
        spark = next(iter(datasets.values())).sparkSession
        order = spark.createDataFrame(list(enumerate(datasets)), "position long, dataset string")
        kinds.append(order.join(table_sections(combined_profile(datasets, mode=mode)), "dataset").select("position", "block"))
    if texts is not None:
        kinds.append(texts)
    if not datasets and (texts is None or texts.isEmpty()):
        return SparkSession.active().createDataFrame([(0, 0, NO_SUMMARY)], "kind int, part long, summary string")
    return one_after_another(kinds, "summary", span, first=0 if datasets else 1)


def task_prompts(
    tasks: DataFrame, template: str, datasets: dict[str, DataFrame], order: list[str], digests: DataFrame, no_digest: str,
    sample_rows: int = 5,
) -> DataFrame:
    """project, seq, prompt: the template filled for every task.

    ``tasks`` has project, seq, task_to_execute and whatever other columns the template names. The template may also name ``data_sample`` and
    ``available_columns`` (first rows in ``order``, and column names, of the first dataset), ``file_names`` (all datasets)
    and ``previous_results_summary`` (the project's row in ``digests``: project, digest; ``no_digest`` where there is none).
    """
    first = next(iter(datasets.values()))
    sample = json_sample(first, order, sample_rows).select("json").scalar()
    held = tasks.join(digests.select("project", F.col("digest").alias("_digest")), "project", "left")
    values = {c: quoted(c) for c in tasks.columns} | {
        "data_sample": sample,
        "available_columns": F.lit(", ".join(first.columns)),
        "file_names": F.lit(", ".join(datasets)),
        "previous_results_summary": F.coalesce("_digest", F.lit(no_digest)),
    }
    return held.select("project", "seq", fill_template(template, values).alias("prompt"))
