"""Queries over tables: sources, sinks, samples and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.operators import profile, sampling
from lodeglass.plans import overview
from lodeglass.session import materialise, scratch_path
from lodeglass.sinks import exports
from lodeglass.sources import tables as sources
from lodeglass.workload.registry import TABLES, null_if, query, rounded, table

# ---- sources -----------------------------------------------------------------------------------

PART_SCHEMA = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]
)


def _gappy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with null types, empty names and a comma and quote in the brand."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_name") == "small ring", F.lit("")).otherwise(F.col("p_name")).alias("p_name"),
        F.concat(F.lit('"A", '), "p_brand").alias("p_brand"),
        null_if(F.col("p_type"), "ECONOMY").alias("p_type"),
        "p_size",
        "p_retailprice",
    )


GAPPY_PART_SQL = """
SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN '' ELSE p_name END AS p_name,
       '"A", ' || p_brand AS p_brand, nullif(p_type, 'ECONOMY') AS p_type, p_size, p_retailprice
FROM part"""


@query("csv_scan", GAPPY_PART_SQL)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv_scan")
    exports.export_csv(_gappy_part(spark, sf_dir), path)
    good, _ = sources.csv_scan(spark, path, PART_SCHEMA)
    return good


@query(
    "csv_quarantine",
    """
SELECT concat_ws(',', p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 45 THEN 'n/a' ELSE p_size::VARCHAR END)
       || CASE WHEN p_size < 5 THEN '' ELSE ',1.5' END || CASE WHEN p_size = 20 THEN ',extra' ELSE '' END AS raw_line
FROM part WHERE p_size > 45 OR p_size < 5 OR p_size = 20""",
)
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short rows, long rows and cells that do not parse, as raw lines."""
    path = scratch_path(spark, "csv_quarantine")
    size = F.col("p_size")
    cells = F.concat_ws(
        ",", "p_partkey", "p_name", "p_brand", "p_type", F.when(size > 45, "n/a").otherwise(size.cast("string"))
    )
    line = F.concat(
        cells, F.when(size < 5, "").otherwise(",1.5"), F.when(size == 20, ",extra").otherwise("")
    )
    # Text files without a header line: the first line of every part file would be taken for one.
    lines = table(spark, sf_dir, "part").select(line.alias("value"))
    lines.write.text(path)
    _, bad = sources.csv_scan(spark, path, PART_SCHEMA, header=False)
    return bad.select("raw_line")


@query(
    "multi_file_ingest",
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS name, 'tabular' AS kind, "
        f"CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, NULL::VARCHAR AS error, "
        f"count(*) AS n_rows, 0::BIGINT AS n_quarantined FROM {t}"
        for t in TABLES
    )
    + " UNION ALL SELECT 'absent.parquet', 'tabular', 'failed', 'PATH_NOT_FOUND', NULL, NULL"
    + " UNION ALL SELECT 'notes.docx', NULL, 'unsupported', 'unsupported file type ''.docx''', NULL, NULL",
)
def multi_file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [f"{sf_dir}/{t}.parquet" for t in TABLES]
    _, outcomes = sources.ingest(spark, [*paths, f"{sf_dir}/absent.parquet", f"{sf_dir}/notes.docx"])
    return outcomes


@query("csv_scan_spanning", "SELECT * FROM documents")
def csv_scan_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in a CSV file as other programs write it: line ends as they are, inside quotes."""
    path = scratch_path(spark, "csv_foreign")
    docs = table(spark, sf_dir, "documents")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    good, _ = sources.csv_scan(spark, path, docs.schema, spanning=True)
    return good


@query(
    "multi_file_ingest_many",
    """
SELECT 'ok' AS status, 24 AS files, count(*) AS n_rows, 'o_orderkey int, o_orderdate date, o_totalprice double' AS types FROM orders
UNION ALL SELECT 'ok', 4, count(*), 'conv_id int, turn int, role string, text string' FROM conversations""",
)
def multi_file_ingest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many CSV files at once, those of one table with cells over several lines, and the types found in each."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    paths = []
    for rows, n in ((orders, 24), (table(spark, sf_dir, "conversations"), 4)):
        folder = scratch_path(spark, "many")
        rows.repartition(n).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
        paths += [r["path"] for r in listed.select("path").collect()]
    datasets, outcomes = sources.ingest(spark, paths)
    types = [(name, ", ".join(f"{c} {t}" for c, t in df.dtypes)) for name, df in datasets.items()]
    typed = spark.createDataFrame(types, "name string, types string")
    return outcomes.join(typed, "name").groupBy("status", "types").agg(
        F.count("*").cast("int").alias("files"), F.sum("n_rows").alias("n_rows")
    )


# ---- sinks -------------------------------------------------------------------------------------


def _exported(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = scratch_path(spark, "export_csv")
    rows = table(spark, sf_dir, name)
    exports.export_csv(rows, path)
    return sources.read_exported_csv(spark, path, rows.schema)


@query("export_csv", "SELECT * FROM documents")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line ends, out and back."""
    return _exported(spark, sf_dir, "documents")


@query("export_csv_numbers", "SELECT * FROM customer")
def export_csv_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "customer")


@query(
    "csv_ingest_quarantine",
    """
SELECT 'ragged.csv' AS name, 'tabular' AS kind, 'quarantined' AS status, NULL::VARCHAR AS error,
       count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_rows, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS n_quarantined
FROM orders""",
)
def csv_ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a line of ragged files: a third fits the header, the others are short or long."""
    path = f"{scratch_path(spark, 'ingest')}/ragged.csv"
    header = "o_orderkey,o_custkey,o_totalprice"
    key = F.col("o_orderkey")
    cells = F.concat_ws(",", key, "o_custkey", "o_totalprice")
    line = F.when(key % 3 == 0, cells).when(key % 3 == 1, key.cast("string")).otherwise(F.concat(cells, F.lit(",x")))
    # Spark writes the header line into each part file; the one text column is the raw line.
    lines = table(spark, sf_dir, "orders").select(line.alias(header))
    lines.write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    _, outcomes = sources.ingest(spark, [path])
    return outcomes


# ---- samples -----------------------------------------------------------------------------------


@query("head_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_sample(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query(
    "json_sample",
    """
SELECT to_json(list({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal,
                     'c_mktsegment': nullif(c_mktsegment, 'HOUSEHOLD')} ORDER BY c_custkey))::VARCHAR AS json
FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)""",
)
def json_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", null_if(F.col("c_mktsegment"), "HOUSEHOLD").alias("c_mktsegment")
    )
    return sampling.json_sample(customer, ["c_custkey"])


LINEITEM_TYPES = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]


@query(
    "schema_listing",
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS filled FROM lineitem"
        for i, (c, t) in enumerate(LINEITEM_TYPES, start=1)
    ),
)
def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.schema_listing(table(spark, sf_dir, "lineitem"), count=True)


# ---- profiles ----------------------------------------------------------------------------------


@query(
    "dataset_shape",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, count(*) AS n_rows, "
        f"(SELECT count(*) FROM (DESCRIBE {t})) AS n_cols FROM {t}"
        for t in TABLES
    ),
)
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_shape({t: table(spark, sf_dir, t) for t in TABLES})


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with null discounts and flags and NaN taxes."""
    discount = F.when(F.col("l_linenumber") != 1, F.col("l_discount"))
    tax = F.when(F.col("l_tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        discount.alias("l_discount"),
        tax.alias("l_tax"),
        null_if(F.col("l_returnflag"), "R").alias("l_returnflag"),
        "l_linestatus",
        "l_shipdate",
    )


GAPPY_LINEITEM_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       CASE WHEN l_linenumber <> 1 THEN l_discount END AS l_discount,
       CASE WHEN l_tax = 0.08 THEN 'NaN'::DOUBLE ELSE l_tax END AS l_tax,
       nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus, l_shipdate
FROM lineitem"""

GAPPY_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]
GAPPY_COLUMNS = [
    *GAPPY_NUMBERS,
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
NUMERIC_STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def numeric_sql(source: str, columns: list[str], whole: list[str]) -> str:
    """One SELECT per numeric column of the CTE or table ``source``; those of ``whole`` are integers."""
    parts = []
    for c in columns:
        own = f"{{}}({c})::VARCHAR" if c in whole else "any_value(NULL::VARCHAR)"
        value = f"CASE WHEN NOT isnan({c}::DOUBLE) THEN {c}::DOUBLE END"
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count,
       count(*) FILTER (isnan({c}::DOUBLE)) AS nan_count, round(avg({value}), 4) AS mean,
       round(stddev_samp({value}), 4) AS std, round(min({value}), 4) AS min,
       round(quantile_cont({value}, 0.25), 4) AS p25, round(quantile_cont({value}, 0.5), 4) AS p50,
       round(quantile_cont({value}, 0.75), 4) AS p75, round(max({value}), 4) AS max,
       {own.format('min')} AS min_exact, {own.format('max')} AS max_exact FROM {source}"""
        )
    return " UNION ALL ".join(parts)


@query(
    "null_counts",
    f"WITH t AS ({GAPPY_LINEITEM_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS null_pct FROM t"
        for c in GAPPY_COLUMNS
    ),
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.null_counts(gappy_lineitem(spark, sf_dir)), "null_pct")


@query("numeric_profile", f"WITH t AS ({GAPPY_LINEITEM_SQL}) " + numeric_sql("t", GAPPY_NUMBERS, GAPPY_NUMBERS[:4]))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Always by the distributed quantiles, also where the input would fit in one buffer."""
    return rounded(profile.numeric_profile(gappy_lineitem(spark, sf_dir)), *NUMERIC_STATS)


LARGE = {"above": "l_orderkey + 9007199254740993", "below": "-l_orderkey - 9007199254740995"}


@query(
    "numeric_profile_large",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", count(*) AS count, min({sql})::VARCHAR AS min_exact, "
        f"max({sql})::VARCHAR AS max_exact, median(({sql})::DOUBLE) AS p50 FROM lineitem"
        for name, sql in LARGE.items()
    ),
)
def numeric_profile_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers that doubles cannot tell apart keep their extremes."""
    large = table(spark, sf_dir, "lineitem").select(*[F.expr(sql).alias(name) for name, sql in LARGE.items()])
    return profile.numeric_profile(large).select("column", "count", "min_exact", "max_exact", "p50")


QUARTERS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
RANK_ERROR = 0.001


def _approx_sql() -> str:
    parts = []
    for c in GAPPY_NUMBERS:
        value = f"CASE WHEN NOT isnan({c}::DOUBLE) THEN {c}::DOUBLE END"
        exact = ", ".join(f"quantile_disc({value}, {q}) AS {name}" for name, q in QUARTERS.items())
        below, upto = (f"avg(({value} {sign} {{}})::INT)" for sign in ("<", "<="))
        cuts = ", ".join(
            f"CASE WHEN {below.format(name)} <= {q - RANK_ERROR} AND {upto.format(name)} >= {q + RANK_ERROR} "
            f"THEN any_value({name}) END AS {name}"
            for name, q in QUARTERS.items()
        )
        close = " AND ".join(
            f"{below.format(name)} <= {q + RANK_ERROR} AND {upto.format(name)} >= {q - RANK_ERROR}" for name, q in QUARTERS.items()
        )
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count,
       count(*) FILTER (isnan({c}::DOUBLE)) AS nan_count, round(avg({value}), 4) AS mean,
       round(stddev_samp({value}), 4) AS std, min({value}) AS min, max({value}) AS max, {cuts}, {close} AS close
FROM t CROSS JOIN (SELECT {exact} FROM t)"""
        )
    return f"WITH t AS ({GAPPY_LINEITEM_SQL}) " + " UNION ALL ".join(parts)


@query("numeric_profile_approx", _approx_sql())
def numeric_profile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-scan form of all numeric columns. ``close``: every sketched quartile has its rank to within a thousandth.

    A sketched quartile is shown where all ranks within a thousandth hold that value: there it is the exact one. Elsewhere it
    is an estimate and only judged.
    """
    lines = gappy_lineitem(spark, sf_dir)
    found = materialise(profile.numeric_profile(lines, GAPPY_NUMBERS, mode="approx"), "sketched")
    values = profile.melt(lines, GAPPY_NUMBERS).where(F.col("value").isNotNull() & ~F.isnan("value"))
    ranks = []
    for name in QUARTERS:
        ranks.append(F.avg((F.col("value") < F.col(name)).cast("double")).alias(f"{name}_below"))
        ranks.append(F.avg((F.col("value") <= F.col(name)).cast("double")).alias(f"{name}_upto"))
    ranked = values.join(F.broadcast(found.select("column", *QUARTERS)), "column").groupBy("column").agg(*ranks)
    judged, shown, close = found.join(ranked, "column", "left"), {}, F.lit(True)
    for name, q in QUARTERS.items():
        below, upto = F.col(f"{name}_below"), F.col(f"{name}_upto")
        shown[name] = F.when((below <= q - RANK_ERROR) & (upto >= q + RANK_ERROR), F.col(name))
        close = close & (below <= q + RANK_ERROR) & (upto >= q - RANK_ERROR)
    out = judged.withColumn("close", close).withColumns(shown).select(*found.columns, "close")
    return rounded(out.drop("min_exact", "max_exact"), "mean", "std")


def string_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count,
       count(DISTINCT {c}) AS n_unique, min({c}) AS min, max({c}) AS max,
       min(length({c})) AS min_len, max(length({c})) AS max_len FROM {source}"""
        for c in columns
    )


@query(
    "string_profile",
    "WITH t AS (SELECT c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer) "
    + string_sql("t", ["c_name", "c_mktsegment"]),
)
def string_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        "c_name", null_if(F.col("c_mktsegment"), "BUILDING").alias("c_mktsegment")
    )
    return profile.string_profile(customer)


def temporal_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS null_count, "
        f"min({c})::VARCHAR AS min, max({c})::VARCHAR AS max FROM {source}"
        for c in columns
    )


@query(
    "temporal_profile",
    "WITH t AS (SELECT o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS day FROM orders) "
    + temporal_sql("t", ["o_orderdate", "day"]),
)
def temporal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    return profile.temporal_profile(table(spark, sf_dir, "orders").select("o_orderdate", day.alias("day")))


@query(
    "boolean_profile",
    "WITH t AS (SELECT CASE WHEN toxic = 0 THEN quality = 1 END AS good, toxic = 1 AS toxic FROM labels) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS null_count, "
        f"count(*) FILTER ({c}) AS true_count, round(count(*) FILTER ({c})::DOUBLE / count({c}), 4) AS true_share, "
        f"min({c}) AS min, max({c}) AS max FROM t"
        for c in ["good", "toxic"]
    ),
)
def boolean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")
    )
    return rounded(profile.boolean_profile(labels), "true_share")


@query(
    "n_unique",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM orders"
        for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    ),
)
def n_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.n_unique(table(spark, sf_dir, "orders"))


@query(
    "dataset_overview",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, '- Tabular: {t} (' || count(*) || ' rows, ' || "
        f"(SELECT count(*) FROM (DESCRIBE {t})) || ' cols)' AS line FROM {t}"
        for t in TABLES
    )
    + " UNION ALL SELECT 'doc_' || doc_id, '- Text: doc_' || doc_id FROM documents",
)
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("name"))
    return overview.dataset_overview({t: table(spark, sf_dir, t) for t in TABLES}, texts)


def long_sql(name: str, types: list[tuple[str, str]]) -> str:
    """SQL for ``profile_long`` in exact mode: one row per statistic."""
    rows: list[str] = []

    def add(kind: str, column: str | None, stat: str, number: str | None, text: str | None = None) -> None:
        rows.append(
            f"{{'dataset': '{name}', 'kind': '{kind}', "
            f"'column': {repr(column) if column else 'NULL::VARCHAR'}, 'stat': '{stat}', "
            f"'value_num': {f'round(({number})::DOUBLE, 4)' if number else 'NULL::DOUBLE'}, "
            f"'value_str': {text or 'NULL::VARCHAR'}}}"
        )

    add("shape", None, "n_rows", "count(*)")
    add("shape", None, "n_cols", str(len(types)) + " + 0 * count(*)")
    for i, (c, dtype) in enumerate(types, start=1):
        add("schema", c, "ordinal", f"{i} + 0 * count(*)")
        add("schema", c, "dtype", None, f"any_value('{dtype}')")
        add("missing", c, "null_count", f"count(*) - count({c})")
        add("missing", c, "null_pct", f"(count(*) - count({c})) * 100.0 / count(*)")
        if dtype in ("bigint", "int", "double"):
            add("numeric", c, "count", f"count({c})")
            add("numeric", c, "nan_count", f"count(*) FILTER (isnan({c}::DOUBLE))")
            for stat, expr in [("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")]:
                add("numeric", c, stat, f"{expr}({c}::DOUBLE)")
            for stat, q in [("p25", 0.25), ("p50", 0.5), ("p75", 0.75)]:
                add("numeric", c, stat, f"quantile_cont({c}::DOUBLE, {q})")
        elif dtype == "string":
            add("string", c, "count", f"count({c})")
            add("string", c, "n_unique", f"count(DISTINCT {c})")
            add("string", c, "min_len", f"min(length({c}))")
            add("string", c, "max_len", f"max(length({c}))")
            add("string", c, "min", None, f"min({c})")
            add("string", c, "max", None, f"max({c})")
        elif dtype.startswith("timestamp"):
            add("temporal", c, "count", f"count({c})")
            add("temporal", c, "min", None, f"min({c})::VARCHAR")
            add("temporal", c, "max", None, f"max({c})::VARCHAR")
    return f"SELECT unnest(r) FROM (SELECT unnest([{', '.join(rows)}]) AS r FROM {name})"


CUSTOMER_TYPES = [
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
ORDERS_TYPES = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query(
    "combined_profile_exact",
    long_sql("orders", ORDERS_TYPES)
    + " UNION ALL "
    + long_sql("customer", CUSTOMER_TYPES)
    + """ UNION ALL SELECT 'doc_' || doc_id, 'text', NULL, 'text_length', length(text)::DOUBLE, NULL FROM documents
UNION ALL SELECT 'doc_' || doc_id, 'text', NULL, 'snippet', NULL,
       CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END FROM documents""",
)
def combined_profile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with exact quartiles and distinct counts, and all documents."""
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer")}
    name = F.concat(F.lit("doc_"), "doc_id")
    texts = overview.texts_long(table(spark, sf_dir, "documents"), name, "text")
    return rounded(overview.combined_profile(tables, texts, mode="exact"), "value_num")


ALL_TYPES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
SKETCHED = ["p25", "p50", "p75", "n_unique"]


def _types(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in ALL_TYPES[name].split(", ")]


def _all_sql() -> str:
    known = {"customer": CUSTOMER_TYPES, "orders": ORDERS_TYPES} | {t: _types(t) for t in ALL_TYPES}
    parts = [long_sql(t, known[t]) for t in TABLES]
    sketched = ", ".join(repr(s) for s in SKETCHED)
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE stat NOT IN ({sketched})"


@query("combined_profile", _all_sql())
def combined_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables, a scan each; without the statistics that are sketched in a single scan."""
    found = overview.combined_profile({t: table(spark, sf_dir, t) for t in TABLES})
    return rounded(found.where(~F.col("stat").isin(SKETCHED)), "value_num")


def _summary_sql(tables: dict[str, list[tuple[str, str]]]) -> str:
    blocks = []
    for position, (name, types) in enumerate(tables.items()):
        lines = []
        for c, dtype in types:
            numbers = "printf('; mean %.4f, min %.4f, max %.4f', avg({0}::DOUBLE), min({0}::DOUBLE), max({0}::DOUBLE))"
            more = f" || {numbers.format(c)}" if dtype in ("int", "bigint", "double") else ""
            lines.append(f"'- {c} ({dtype}): ' || (count(*) - count({c})) || ' missing'{more} || chr(10)")
        names = ", ".join(c for c, _ in types)
        blocks.append(
            f"SELECT 0 AS kind, {position} AS position, chr(10) || '## Profile: {name}' || chr(10) || 'Shape: (' || count(*) || "
            f"', {len(types)})' || chr(10) || 'Columns: {names}' || chr(10) || {' || '.join(lines)} AS block FROM {name}"
        )
    texts = (
        "SELECT 1, doc_id, chr(10) || '## Text Document: doc_' || doc_id || chr(10) || 'Snippet: ' "
        "|| CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END || chr(10) FROM documents"
    )
    return (
        f"WITH b AS ({' UNION ALL '.join(blocks)} UNION ALL {texts}) SELECT kind, (position // 1000)::BIGINT AS part, "
        "string_agg(block, '' ORDER BY position) AS summary FROM b GROUP BY kind, part"
    )


@query("profile_summary", _summary_sql({t: _types(t) for t in ("nation", "labels", "supplier")}))
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt says about three tables and all documents."""
    tables = {t: table(spark, sf_dir, t) for t in ("nation", "labels", "supplier")}
    docs = table(spark, sf_dir, "documents")
    texts = overview.text_sections(docs, F.concat(F.lit("doc_"), "doc_id"), "text", F.col("doc_id"))
    return overview.profile_summary(tables, texts)


@query("export_profiles_json", long_sql("customer", CUSTOMER_TYPES))
def export_profiles_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export_profiles")
    long = overview.profile_long(table(spark, sf_dir, "customer"), "customer", mode="exact")
    exports.export_profiles_json(long, path)
    return rounded(sources.read_json(spark, path, long.schema), "value_num")


@query(
    "export_ingested_json",
    "SELECT event_id, ts, user_id, event_type, nullif(props, '{}') AS props, value FROM events",
)
def export_ingested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through the JSON sink and the JSON source."""
    path = scratch_path(spark, "export_json")
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", null_if(F.col("props"), "{}").alias("props"), "value"
    )
    exports.export_profiles_json(events, path)
    return sources.read_json(spark, path, events.schema)
