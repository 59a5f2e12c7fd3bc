"""Table and text sources with per-source outcomes."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.text import extension_of
from lodeglass.sources import batches
from lodeglass.sources.batches import CORRUPT, CSV_OPTIONS, NULL_TOKEN, Datasets
from lodeglass.sources.batches import quoted_name as _quoted

#: Schemas of Parquet and JSON files that the driver asks for at the same time.
ASKED_AT_ONCE = 16


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with a header. Give a schema for repeat loads: it saves the inference scan."""
    reader = spark.read.option("header", True).options(**CSV_OPTIONS)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_exported_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``sinks.exports.export_csv`` wrote, with line ends in texts and nested values restored."""
    flat = T.StructType([T.StructField(f.name, _cell_type(f.dataType)) for f in schema])

    def restored(field: T.StructField) -> Column:
        c = _quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            # between escaped backslashes, a backslash and a letter stand for a line end
            parts = F.transform(
                F.split(c, r"\\\\", -1),
                lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
            )
            return F.array_join(parts, "\\").alias(field.name)
        if isinstance(field.dataType, T.BinaryType):
            return F.unbase64(c).alias(field.name)
        if _cell_type(field.dataType) != field.dataType:
            return F.from_json(c, field.dataType).alias(field.name)
        return c

    return read_csv(spark, path, flat).select(*[restored(f) for f in schema])


def _cell_type(kind: T.DataType) -> T.DataType:
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    return T.StringType() if nested else kind


def csv_scan(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, spanning: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine). The quarantine is (source, raw_line) of rows that do not fit the schema.

    ``spanning`` reads cells that hold line ends, as spreadsheets and other engines write them, in quotes. It shuffles the lines once; blocks
    of a file are still read apart.
    """
    if spanning:
        rows = batches.judged_records(spark, [path], schema, header)
        name = F.element_at(F.split("file", "/"), -1)
        return (
            rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file"),
            rows.where(F.col(CORRUPT).isNotNull()).select(F.url_decode(name).alias("source"), F.col(CORRUPT).alias("raw_line")),
        )
    rows, parsed = _judged_csv(spark, path, schema, header)
    good = rows.where(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT)
    bad = rows.where(F.col(CORRUPT).isNotNull() & parsed)
    return good, bad.select(F.col("_metadata.file_name").alias("source"), F.col(CORRUPT).alias("raw_line"))


def _judged_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool
) -> tuple[DataFrame, Column]:
    """All rows, with the raw line of those that do not fit, and a test that is always true but reads every cell."""
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # A row is judged by all its cells, whatever columns the query keeps later. Spark would parse
    # only the kept ones, so both filters look at every field through a test that is always true.
    rows = (
        spark.read.option("header", header)
        .option("nullValue", NULL_TOKEN)
        .option("escape", '"')
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(marked)
        .csv(path)
    )
    return rows, F.xxhash64(*[_quoted(f.name) for f in schema.fields]) >= F.lit(-(2**63))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """name, file_type, text, text_length: one row per file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")
    )
    return text_ingest(files, F.col("name"), "text")


def text_ingest(df: DataFrame, name: Column, text: str, file_type: Column | None = None) -> DataFrame:
    """name, file_type, text, text_length from a text column of any table."""
    kind = file_type if file_type is not None else F.replace(extension_of(name), F.lit("."), F.lit(""))
    return df.select(
        name.alias("name"),
        kind.alias("file_type"),
        F.col(text).alias("text"),
        F.length(text).cast("long").alias("text_length"),
    )


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


READERS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    ".csv": ("tabular", read_csv),
    ".parquet": ("tabular", read_parquet),
    ".json": ("tabular", read_json),
    ".txt": ("text", read_text_files),
    ".md": ("text", read_text_files),
}


def _reason(problem: PySparkException | Py4JJavaError) -> str:
    """The error's stable name, without paths or traces."""
    if isinstance(problem, PySparkException):
        return problem.getCondition() or type(problem).__name__
    return problem.java_exception.getClass().getSimpleName()


Outcome = tuple[str, str | None, str, str | None, int | None, int | None]
OUTCOMES = "name string, kind string, status string, error string, n_rows long, n_quarantined long"


def ingest(
    spark: SparkSession, paths: list[str], schemas: dict[str, T.StructType] | None = None
) -> tuple[Datasets, DataFrame]:
    """(datasets by name, outcomes). One bad source never stops the batch.

    ``schemas`` by name spares CSV and JSON sources the extra scan that infers their types.

    Outcomes are (name, kind, status, error, n_rows, n_quarantined) with status ok, quarantined, empty,
    failed or unsupported. The status is judged over the whole source: every cell is read. Rows of a CSV
    file that do not fit its schema, given or inferred, are left out of the dataset, counted, and make the
    status ``quarantined``; ``csv_scan`` with the dataset's schema returns them. A text counts as ok when it
    has any character. Two sources of one name are an error.

    Files are read together: all texts in one job, CSV files in one scan that looks at their headers and quotes and two for each
    kind of header, Parquet and JSON files in one for each schema. Folders are read one by one.
    """
    names = [posixpath.basename(path.rstrip("/")) for path in paths]
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate dataset names {sorted({n for n in names if names.count(n) > 1})}")
    known = schemas or {}
    found: dict[str, Outcome] = {}
    makers: dict[str, Callable[[], DataFrame]] = {}
    files: dict[str, dict[str, str]] = {}  # by suffix: place to name
    for path, name in zip(paths, names, strict=True):
        suffix = posixpath.splitext(name)[1].lower()
        if suffix not in READERS:
            found[name] = (name, None, "unsupported", f"unsupported file type {suffix!r}", None, None)
        elif place := _file(spark, path):
            files.setdefault(suffix, {})[place] = name
        else:
            _alone(spark, path, name, known.get(name), found, makers)
    at = {name: path for path, name in zip(paths, names, strict=True)}
    for suffix, places in files.items():
        together = {".csv": _csv_batch, ".parquet": _typed_batch, ".json": _typed_batch}.get(suffix, _text_batch)
        try:
            together(spark, places, at, known, found, makers)
        except (PySparkException, Py4JJavaError):  # some file cannot be read: find out which
            for name in places.values():
                if name not in found:
                    _alone(spark, at[name], name, known.get(name), found, makers)
    ordered = Datasets({n: makers[n] for n in names if n in makers})
    return ordered, spark.createDataFrame([found[n] for n in names], OUTCOMES)


def _file(spark: SparkSession, path: str) -> str | None:
    """The place of a path that is one file, as rows read from it will name it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isFile():
        return None
    return _canonical(system.makeQualified(place).toUri().toString())


def _canonical(uri: str) -> str:
    return "file:/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _status(name: str, kind: str, n_rows: int, n_bad: int = 0) -> Outcome:
    return (name, kind, "quarantined" if n_bad else "ok" if n_rows else "empty", None, n_rows, n_bad)


def _alone(
    spark: SparkSession, path: str, name: str, schema: T.StructType | None, found: dict[str, Outcome],
    makers: dict[str, Callable[[], DataFrame]],
) -> None:
    """One source by itself."""
    kind, reader = READERS[posixpath.splitext(name)[1].lower()]
    try:
        df = reader(spark, path) if schema is None else reader(spark, path, schema)
        if reader is read_csv:
            rows, every_cell = _judged_csv(spark, path, df.schema, True)
            fits = F.col(CORRUPT).isNull()
            n_rows, n_bad = rows.where(every_cell).agg(F.count_if(fits), F.count_if(~fits)).first()
            df = csv_scan(spark, path, df.schema)[0] if n_bad else df
        else:
            n_rows, n_bad = _whole(df, kind), 0
    except (PySparkException, Py4JJavaError) as problem:
        found[name] = (name, kind, "failed", _reason(problem), None, None)
        return
    makers[name] = lambda: df
    found[name] = _status(name, kind, n_rows, n_bad)


def _by_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", batches.file_column())


def _text_batch(spark, places, at, known, found, makers) -> None:
    texts = _by_file(spark.read.text([at[n] for n in places.values()], wholetext=True))
    filled = {r["file"]: r["n"] for r in texts.groupBy("file").agg(F.count_if(F.length("value") > 0).alias("n")).collect()}
    sizes = {_canonical(f): n for f, n in filled.items()}
    for place, name in places.items():
        makers[name] = partial(read_text_files, spark, at[name])
        found[name] = _status(name, "text", sizes.get(place, 0))


def _csv_batch(spark, places, at, known, found, makers) -> None:
    def paths(group: list[str]) -> list[str]:
        return [at[n] for n in group]

    def named(by_file: dict) -> dict:
        return {places[_canonical(f)]: v for f, v in by_file.items()}

    looked = named({r["file"]: r for r in batches.survey(spark, paths(list(places.values()))).collect()})
    for name in places.values():
        if name not in looked:  # no line at all
            schema = known.get(name, T.StructType())
            makers[name] = partial(spark.createDataFrame, [], schema)
            found[name] = _status(name, "tabular", 0)
    titles = batches.column_names(spark, sorted({r["header"] for r in looked.values()}))
    types = {n: known[n] for n in looked if n in known}
    alike: dict[tuple[str, bool], list[str]] = {}
    for name, row in looked.items():
        if name not in types:
            alike.setdefault((row["header"], row["spans"]), []).append(name)
    for (header, spans), group in alike.items():
        texts = T.StructType([T.StructField(c, T.StringType()) for c in titles[header]])
        if spans:
            rows = batches.judged_records(spark, paths(group), texts)
        else:
            rows = _by_file(spark.read.option("header", True).options(**CSV_OPTIONS).schema(texts).csv(paths(group)))
        guessed = named(batches.inferred(rows, texts.names))
        types |= {n: guessed.get(n, texts) for n in group}
    same: dict[tuple[str, bool], list[str]] = {}
    for name, row in looked.items():
        same.setdefault((types[name].json(), row["spans"]), []).append(name)
    for (_, spans), group in same.items():
        schema = types[group[0]]
        if spans:
            rows = batches.judged_records(spark, paths(group), schema)
        else:
            rows, every_cell = _judged_csv(spark, paths(group), schema, True)
            rows = _by_file(rows.where(every_cell))
        sizes = named(batches.counted(rows, schema.names))
        for name in group:
            good, bad = sizes.get(name, (0, 0))
            if spans or bad:
                makers[name] = partial(_good_rows, spark, at[name], schema, spans)
            else:
                makers[name] = partial(read_csv, spark, at[name], schema)
            found[name] = _status(name, "tabular", good, bad)


def _good_rows(spark: SparkSession, path: str, schema: T.StructType, spans: bool) -> DataFrame:
    return csv_scan(spark, path, schema, spanning=spans)[0]


def _typed_batch(spark, places, at, known, found, makers) -> None:
    def schema_of(name: str) -> T.StructType | None:
        try:
            return known.get(name) or reader(spark, at[name]).schema
        except (PySparkException, Py4JJavaError) as problem:
            found[name] = (name, kind, "failed", _reason(problem), None, None)
            return None

    kind, reader = READERS[posixpath.splitext(next(iter(places.values())))[1].lower()]
    with ThreadPoolExecutor(ASKED_AT_ONCE) as pool:
        types = dict(zip(places.values(), pool.map(schema_of, places.values()), strict=True))
    alike: dict[str, list[str]] = {}
    for name, schema in types.items():
        if schema is not None:
            alike.setdefault(schema.json(), []).append(name)
    for group in alike.values():
        schema = types[group[0]]
        rows = _by_file(_read_many(spark, reader, [at[n] for n in group], schema)).withColumn(CORRUPT, F.lit(None))
        cells = [f.name for f in schema if "map<" not in f.dataType.simpleString()]
        try:
            sizes = {places[_canonical(f)]: n for f, (n, _) in batches.counted(rows, cells).items()}
        except (PySparkException, Py4JJavaError):
            for name in group:
                _alone(spark, at[name], name, schema, found, makers)
            continue
        for name in group:
            makers[name] = partial(reader, spark, at[name], schema)
            found[name] = _status(name, kind, sizes.get(name, 0))


def _read_many(spark: SparkSession, reader: Callable[..., DataFrame], paths: list[str], schema: T.StructType) -> DataFrame:
    typed = spark.read.schema(schema)
    return typed.json(paths) if reader is read_json else typed.parquet(*paths)


def _whole(df: DataFrame, kind: str) -> int:
    """Rows (texts with any character) of a source all of whose cells can be read."""
    kept = df.where(F.col("text_length") > 0) if kind == "text" else df
    cells = [_quoted(f.name) for f in kept.schema if "map<" not in f.dataType.simpleString()]
    read = F.bit_xor(F.xxhash64(*cells)) if cells else F.count(F.lit(1))
    return kept.agg(F.count(F.lit(1)), read).first()[0]
