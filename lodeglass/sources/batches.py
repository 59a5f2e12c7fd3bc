"""Many files as a few jobs: outcomes of whole batches, types of CSV files, and CSV records that span lines.

Files are read together by kind and schema, and told apart by the path that Spark gives with every row. What has to be known before a file can be
read (header, types, whether cells span lines) comes from scans over all CSV files at once.

A line of a CSV file begins a record if the quotes before it are even in number. Their parity at the start of each block of a file comes
from the sums of the blocks before it, so blocks are still read apart from one another, also when a cell holds line ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeglass.operators.joins import join_on
from lodeglass.session import materialise

# An unquoted empty cell is null and a quoted one is an empty string, which takes a null token
# other than the empty string.
NULL_TOKEN = "\\N"
CORRUPT = "_corrupt_record"
CSV_OPTIONS = {"nullValue": NULL_TOKEN, "escape": '"'}
#: Columns whose types one aggregate finds out.
TYPED_AT_ONCE = 40

#: From narrow to wide; each is a pattern that a cell's text must match, and a type that it must cast to.
_WHOLE = r"^[+-]?[0-9]+$"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
TYPES: list[tuple[T.DataType, str]] = [
    (T.IntegerType(), _WHOLE),
    (T.LongType(), _WHOLE),
    (T.DoubleType(), r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Inf)$"),
    (T.DateType(), f"^{_DAY}$"),
    (T.TimestampType(), f"^{_DAY}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$"),
    (T.BooleanType(), "^(?i)(true|false)$"),
]


class Datasets(Mapping[str, DataFrame]):
    """Datasets by name; a frame is made when it is asked for first."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def quoted_name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def file_column() -> Column:
    return F.col("_metadata.file_path")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, line, text, quotes: every line with its place."""
    text = F.col("value")
    return spark.read.option("lineSep", "\n").text(paths).select(
        file_column().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),  # ascends inside a block
        text.alias("text"),
        (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))).alias("quotes"),
    )


def survey(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, header, spans: of each CSV file its first record, and whether some record spans lines. One scan of all files."""
    blocks = _lines(spark, paths).groupBy("file", "block").agg(
        F.max(F.col("quotes") % 2).alias("odd"), F.min_by("text", "line").alias("first")
    )
    return blocks.groupBy("file").agg(
        F.rtrim(F.min_by("first", "block"), F.lit("\r")).alias("header"), (F.max("odd") == 1).alias("spans")
    )


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, first, record: the records of CSV files, cells with line ends included; ``first`` marks a file's first one."""
    lines = _lines(spark, paths)
    per_file = Window.partitionBy("file").orderBy("block")
    sums = materialise(lines.groupBy("file", "block").agg(F.sum("quotes").alias("sum")), "quotes")
    gone = F.coalesce(F.sum("sum").over(per_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("file", "block", (gone % 2).alias("carried"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    before = F.col("carried") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(starts, ["file", "block"]).withColumn("before", before % 2)
    numbered = placed.withColumn(
        "n", F.sum((F.col("before") == 0).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    closed = (F.col("before") == 0) & (F.col("quotes") % 2 == 0)
    whole = numbered.where(closed).select("file", "block", "n", F.col("text").alias("record"))
    # lines before a block's first record belong to the last record of the blocks before it
    parts = materialise(numbered.where(~closed).select("file", "block", "line", "n", "text"), "spanning")
    counts = numbered.groupBy("file", "block").agg(F.max("n").alias("last"))
    held = F.when(F.col("last") > 0, F.struct(F.col("block").alias("block"), F.col("last").alias("n")))
    owner = F.last(held, ignorenulls=True).over(per_file.rowsBetween(Window.unboundedPreceding, -1))
    owners = counts.select("file", "block", owner.alias("owner")).where(F.col("owner").isNotNull())
    owned = parts.join(owners, ["file", "block"], "left").select(
        "file",
        F.when(F.col("n") == 0, F.col("owner.block")).otherwise(F.col("block")).alias("of"),
        F.when(F.col("n") == 0, F.col("owner.n")).otherwise(F.col("n")).alias("n"),
        F.struct("block", "line", "text").alias("part"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "\n")
    spanning = owned.groupBy("file", "of", "n").agg(text.alias("record")).withColumnRenamed("of", "block")
    both = whole.unionByName(spanning.select("file", "block", "n", "record"))
    first = (F.col("block") == 0) & (F.col("n") == 1)
    return both.select("file", first.alias("first"), F.rtrim("record", F.lit("\r")).alias("record"))


def judged_records(spark: SparkSession, paths: list[str], schema: T.StructType, header: bool = True) -> DataFrame:
    """file, the columns of ``schema`` and the raw record of those that do not fit it."""
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**CSV_OPTIONS, "columnNameOfCorruptRecord": CORRUPT}
    rows = records(spark, paths).where(F.col("record") != "")
    rows = rows.where(~F.col("first")) if header else rows
    parsed = F.from_csv("record", _ddl(marked), options)
    return rows.select("file", parsed.alias("_row")).select("file", "_row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def column_names(spark: SparkSession, headers: list[str]) -> dict[str, list[str]]:
    """The cells of each header line, as the CSV reader names them."""
    width = max((h.count(",") + 1 for h in headers), default=1)
    cells = _ddl(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)]))
    rows = spark.createDataFrame([(h,) for h in headers], "header string")
    parsed = rows.select("header", F.from_csv("header", cells, {"escape": '"'}).alias("c"))
    out = {}
    for row in parsed.collect():
        found = list(row["c"])
        while len(found) > 1 and found[-1] is None and not row["header"].endswith(","):
            found.pop()
        named = [c if c else f"_c{i}" for i, c in enumerate(found)]
        again = {c.lower() for c in named if [n.lower() for n in named].count(c.lower()) > 1}
        out[row["header"]] = [f"{c}{i}" if c.lower() in again else c for i, c in enumerate(named)]
    return out


def inferred(rows: DataFrame, names: list[str]) -> dict[str, T.StructType]:
    """The schema of each file (column ``file``) of ``rows``, whose other columns are texts: the narrowest type that fits all cells.

    A column without any value is text.
    """
    found: dict[str, list[T.StructField]] = {}
    for start in range(0, len(names), TYPED_AT_ONCE):
        some = names[start : start + TYPED_AT_ONCE]
        tests = []
        for i, name in enumerate(some):
            c = quoted_name(name)
            tests.append(F.count(c).alias(f"n{i}"))
            for k, (kind, pattern) in enumerate(TYPES):
                number = F.when(F.trim(c).isin("Inf", "+Inf", "-Inf"), F.lit("1")).otherwise(c)
                fits = F.rlike(c, F.lit(pattern)) & number.try_cast(kind).isNotNull()
                tests.append(F.every(F.when(c.isNotNull(), fits)).alias(f"t{i}_{k}"))
        for row in rows.groupBy("file").agg(*tests).collect():
            kinds = [
                next((kind for k, (kind, _) in enumerate(TYPES) if row[f"t{i}_{k}"]), T.StringType()) if row[f"n{i}"] else T.StringType()
                for i in range(len(some))
            ]
            found.setdefault(row["file"], []).extend(T.StructField(n, k) for n, k in zip(some, kinds, strict=True))
    return {file: T.StructType(fields) for file, fields in found.items()}


def counted(rows: DataFrame, cells: list[str]) -> dict[str, tuple[int, int]]:
    """Of each file the rows that fit and those that do not; every cell is read."""
    read = F.bit_xor(F.xxhash64(*[quoted_name(c) for c in cells])) if cells else F.count(F.lit(1))
    fits = F.col(CORRUPT).isNull()
    found = rows.groupBy("file").agg(F.count_if(fits).alias("good"), F.count_if(~fits).alias("bad"), read.alias("read"))
    return {r["file"]: (r["good"], r["bad"]) for r in found.collect()}
