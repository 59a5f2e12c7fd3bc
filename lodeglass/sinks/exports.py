"""Exports. Each writes a directory of part files in parallel; an existing target is an error."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.operators.joins import join_on
from lodeglass.operators.ordering import number_within
from lodeglass.operators.profile import quoted
from lodeglass.session import materialise
from lodeglass.sinks.commits import CommitLog
from lodeglass.sources.tables import NULL_TOKEN

#: Times keep their microseconds; written so, readers without a format understand them.
TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
LEDGER_SCHEMA = (
    "project string, seq long, task string, files array<string>, approach string, "
    "code string, results_text string, insights string"
)
CONVERSATION_SCHEMA = "conv_id long, seq long, role string, content string"


def as_cells(df: DataFrame) -> DataFrame:
    """One line per row whatever the cells hold: line ends (and backslashes) in texts are escaped, nested
    values are JSON, binary ones base 64.

    ``sources.tables.read_exported_csv`` undoes it. Escaped line ends keep the files splittable.
    """

    def cell(field: T.StructField) -> Column:
        c = quoted(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(field.name)
        if isinstance(field.dataType, T.BinaryType):
            return F.base64(c).alias(field.name)
        if not isinstance(field.dataType, T.StringType):
            return c
        for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(plain), F.lit(escaped))
        return c.alias(field.name)

    return df.select(*[cell(f) for f in df.schema])


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, cells as in ``as_cells``.

    ``single_file`` funnels everything through one task: small tables only.
    """
    cells = as_cells(df)
    out = cells.coalesce(1) if single_file else cells
    out.write.options(**TIMES).option("header", True).option("nullValue", NULL_TOKEN).option("emptyValue", '""').option(
        "escape", '"'
    ).csv(path)


def export_tables(datasets: dict[str, DataFrame], folder: str) -> tuple[dict[str, str], dict[str, str]]:
    """Every table as CSV under its own name: (paths by name, reasons by name of those that could not be written).

    A table that cannot be written does not stop the others.
    """
    paths: dict[str, str] = {}
    failed: dict[str, str] = {}
    for name, df in datasets.items():
        try:
            export_csv(df, f"{folder}/{name}")
            paths[name] = f"{folder}/{name}"
        except (PySparkException, Py4JJavaError) as problem:
            failed[name] = str(problem).splitlines()[0]
    return paths, failed


def export_profiles_json(profile: DataFrame, path: str) -> None:
    """A long profile as JSON lines; numbers stay numbers, nulls are written out."""
    profile.write.options(**TIMES).option("ignoreNullFields", False).json(path)


def export_texts_json(texts: DataFrame, path: str) -> None:
    texts.select("name", "text").write.json(path)


def _ledger(spark: SparkSession, path: str, group: str) -> CommitLog:
    """The entries, and for each group the last number given: a batch looks up that index, never the entries."""
    return CommitLog(
        spark, path, {"rows": lambda rows: rows, "index": lambda i: i.groupBy(group).agg(F.max("last").alias("last"))}
    )


def _append_numbered(rows: DataFrame, path: str, schema: str, group: str, order: list[str], batch: str | None) -> None:
    """Append rows, numbered on from each group's last ``seq``, without gaps whoever else appends meanwhile.

    A ``batch`` with a name is appended once, however often it is tried.
    """
    names = [f.split(" ")[0] for f in schema.split(", ")]
    fields = T.StructType.fromDDL(schema)
    log = _ledger(rows.sparkSession, path, group)
    numbered = number_within(rows, [group], [F.col(c) for c in order], "_at")
    sizes = materialise(numbered.groupBy(group).agg(F.max("_at").alias("_size")), "sizes")
    index = T.StructType([fields[group], T.StructField("last", T.LongType())])

    def parts(head):
        known = log.read("index", index, head).groupBy(group).agg(F.max("last").alias("_known"))
        last = join_on(sizes, known, [group], "left").withColumn("_last", F.coalesce("_known", F.lit(0)))
        placed = join_on(numbered, last.select(group, "_last"), [group]).withColumn("seq", F.col("_at") + F.col("_last"))
        cells = [F.col(n).cast(fields[n].dataType).alias(n) for n in names]
        return {"rows": placed.select(*cells), "index": last.select(group, (F.col("_last") + F.col("_size")).alias("last"))}

    log.append(batch or uuid.uuid4().hex, parts)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The results so far; a ledger never written to is empty."""
    return _ledger(spark, path, "project").read("rows", LEDGER_SCHEMA)


def append_results(results: DataFrame, path: str, order: list[str], batch: str | None = None) -> None:
    """Append results; a ``batch`` with a name is appended once, however often it is tried."""
    _append_numbered(results, path, LEDGER_SCHEMA, "project", order, batch)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return _ledger(spark, path, "conv_id").read("rows", CONVERSATION_SCHEMA)


def append_conversations(entries: DataFrame, path: str, order: list[str], batch: str | None = None) -> None:
    """Append (conv_id, role, content) entries; content is forced to text."""
    texts = entries.withColumn("content", F.col("content").cast("string"))
    _append_numbered(texts, path, CONVERSATION_SCHEMA, "conv_id", order, batch)


def export_conversations_json(conversations: DataFrame, path: str) -> None:
    """The whole history as JSON lines; entries follow one another in files that follow one another by name."""
    order = ["conv_id", "seq"]
    ordered = conversations.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("conv_id", "seq", "role", "content").write.option("ignoreNullFields", False).json(path)


def export_ledger_json(ledger: DataFrame, path: str) -> None:
    ledger.write.options(**TIMES).option("ignoreNullFields", False).json(path)


def report_sink(reports: DataFrame, text: str, path: str, order: list[str], name: str | None = None) -> None:
    """Reports as text files in reading order: parts of one report follow one another.

    With ``name``, a column, each of its values has a folder of its own, ``<path>/<name>=<value>``, which holds that report
    alone; the files of a folder follow one another by name. A report is written as it is, line ends included.
    """
    ordered = reports.repartitionByRange(*order).sortWithinPartitions(*order)
    if name is None:
        ordered.select(F.col(text).alias("value")).write.text(path)
    else:
        ordered.select(F.col(text).alias("value"), name).write.partitionBy(name).text(path)


def read_reports(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``name, value``: the lines of the reports written under their names, in no order."""
    return spark.read.schema(f"value string, {name} string").text(path).select(name, "value")
