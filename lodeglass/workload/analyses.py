"""Queries for statistics, data quality, cleaning, periods and dataset matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.operators import periods, quality, sampling, statistics
from lodeglass.plans import cleaning
from lodeglass.plans.cleaning import Step
from lodeglass.workload.registry import null_if, query, rounded, table

# ---- dependence and distributions --------------------------------------------------------------

CORRELATED = ["constant", "l_discount", "l_extendedprice", "l_quantity", "l_tax"]


def _correlation_sql() -> str:
    parts = []
    for i, x in enumerate(CORRELATED):
        for y in CORRELATED[i + 1 :]:
            parts.append(
                f"SELECT '{x}' AS x, '{y}' AS y, regr_count({y}, {x})::BIGINT AS n, "
                f"round(regr_sxy({y}, {x}) / nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0), 4) + 0.0 AS r "
                "FROM t"
            )
    return (
        "WITH t AS (SELECT CASE WHEN l_linenumber <> 1 THEN l_discount END AS l_discount, l_extendedprice, "
        "l_quantity, l_tax, 1.0::DOUBLE AS constant FROM lineitem) " + " UNION ALL ".join(parts)
    )


@query("correlation_matrix", _correlation_sql())
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("l_discount"),
        "l_extendedprice",
        "l_quantity",
        "l_tax",
        F.lit(1.0).alias("constant"),
    )
    found = statistics.correlation_matrix(lines, CORRELATED)
    return found.withColumn("r", F.round("r", 4) + F.lit(0.0))


# Thirty columns with gaps of their own, as SQL that both engines read.
WIDE = {
    f"c{i:02}": f"CASE WHEN (l_orderkey + l_linenumber) % {i + 3} <> 0 THEN "
    f"CAST(l_extendedprice * {i % 4} + l_quantity * {i} + (l_partkey % {i + 2}) * 1000 AS DOUBLE) END"
    for i in range(30)
}


def _wide_sql() -> str:
    names = list(WIDE)
    cells = [
        f"{{'x': '{x}', 'y': '{y}', 'n': regr_count({y}, {x})::BIGINT, 'r': round(regr_sxy({y}, {x}) "
        f"/ nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0), 4) + 0.0}}"
        for i, x in enumerate(names)
        for y in names[i + 1 :]
    ]
    columns = ", ".join(f"{sql} AS {name}" for name, sql in WIDE.items())
    return (
        f"WITH t AS (SELECT {columns} FROM lineitem), p AS (SELECT unnest([{', '.join(cells)}]) AS p FROM t) "
        "SELECT p.x, p.y, p.n, p.r FROM p"
    )


@query("correlation_matrix_wide", _wide_sql())
def correlation_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 435 pairs of thirty columns, each over the rows where both are filled."""
    lines = table(spark, sf_dir, "lineitem").select(*[F.expr(sql).alias(name) for name, sql in WIDE.items()])
    found = statistics.correlation_matrix(lines, list(WIDE))
    return found.withColumn("r", F.round("r", 4) + F.lit(0.0))


FREQUENCY_SQL = """
WITH c AS (SELECT {value} AS value, count(*) AS n FROM {source} GROUP BY 1)
SELECT value, n, round(n / (SELECT sum(n) FROM c)::DOUBLE, 6) AS share,
       row_number() OVER (ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM c"""


@query("frequency_counts", FREQUENCY_SQL.format(value="CASE WHEN l_partkey <> 1 THEN l_partkey END", source="lineitem"))
def frequency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its place; a null stands for one of them."""
    parts = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") != 1, F.col("l_partkey")).alias("part"))
    return rounded(statistics.frequency_counts(parts, "part"), "share", digits=6)


@query(
    "frequency_counts_top",
    FREQUENCY_SQL.format(value="nullif(event_type, 'error')", source="events") + " ORDER BY rank LIMIT 3",
)
def frequency_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(null_if(F.col("event_type"), "error").alias("kind"))
    return rounded(statistics.frequency_counts(events, "kind", top_k=3), "share", digits=6)


@query(
    "chart_data_bar",
    """
SELECT l_returnflag AS x, sum((l_extendedprice * 100)::BIGINT)::BIGINT AS y FROM lineitem GROUP BY l_returnflag""",
)
def chart_data_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return sampling.chart_data_bar(table(spark, sf_dir, "lineitem"), "l_returnflag", F.sum(cents))


@query(
    "chart_data_scatter",
    """
SELECT o_orderdate AS x, o_totalprice AS y, o_orderkey AS key FROM orders
ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000""",
)
def chart_data_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.chart_data_scatter(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "linear_fit",
    """
SELECT l_returnflag AS "group", regr_count(l_extendedprice, l_quantity)::BIGINT AS n,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY l_returnflag""",
)
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    fit = statistics.linear_fit(lines, F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_returnflag"))
    return rounded(rounded(fit, "slope", "intercept"), "r2", digits=6)


@query(
    "linear_fit_multiple",
    """
WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS y FROM lineitem),
s AS (SELECT regr_sxx(l_extendedprice, l_quantity) AS aa, regr_sxx(l_extendedprice, l_discount) AS bb,
             regr_sxy(l_discount, l_quantity) AS ab, regr_sxy(l_extendedprice, l_quantity) AS ay,
             regr_sxy(l_extendedprice, l_discount) AS b_y FROM lineitem),
c AS (SELECT (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS p, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s)
SELECT 'intercept' AS term, round(y - p * a - q * b, 2) AS coefficient FROM m, c
UNION ALL SELECT 'l_quantity', round(p, 2) FROM c UNION ALL SELECT 'l_discount', round(q, 2) FROM c""",
)
def linear_fit_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    fit = statistics.linear_fit_multiple(lines, "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(fit, "coefficient", digits=2)


OUTLIER_SQL = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b
           FROM events GROUP BY event_type),
f AS (SELECT event_type, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q)"""


@query(
    "outlier_flags",
    OUTLIER_SQL
    + """
SELECT event_type, 'value' AS "column", round(low, 4) AS low, round(high, 4) AS high,
       count(*) FILTER (value < low) AS n_low, count(*) FILTER (value > high) AS n_high
FROM events JOIN f USING (event_type) GROUP BY ALL""",
)
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences per event type, by the distributed quantiles."""
    events = table(spark, sf_dir, "events")
    return rounded(statistics.outlier_flags(events, ["value"], by=["event_type"]), "low", "high")


@query(
    "outlier_flags_zscore",
    " UNION ALL ".join(
        f"""
SELECT '{c}' AS "column", round(avg({c}) - 3 * stddev_samp({c}), 4) AS low,
       round(avg({c}) + 3 * stddev_samp({c}), 4) AS high,
       (SELECT count(*) FROM events WHERE {c} < (SELECT avg({c}) - 3 * stddev_samp({c}) FROM events)) AS n_low,
       (SELECT count(*) FROM events WHERE {c} > (SELECT avg({c}) + 3 * stddev_samp({c}) FROM events)) AS n_high
FROM events"""
        for c in ["value", "user_id"]
    ),
)
def outlier_flags_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rounded(statistics.outlier_flags(events, ["value", "user_id"], "zscore"), "low", "high")


@query(
    "outlier_rows",
    """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id AS key, 'value' AS "column", value, 'iqr' AS method FROM events, q
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
def outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.outlier_rows(table(spark, sf_dir, "events"), "event_id", ["value"])


@query(
    "histogram",
    """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
n AS (SELECT least(floor(40 * (value - lo) / (hi - lo))::BIGINT + 1, 40) AS bin, count(*) AS n
      FROM events, b GROUP BY 1)
SELECT i AS bin, round(lo + (i - 1) * ((hi - lo) / 40), 6) AS lo, round(lo + i * ((hi - lo) / 40), 6) AS hi,
       coalesce(n, 0) AS n
FROM range(1, 41) AS r(i) CROSS JOIN b LEFT JOIN n ON n.bin = i""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.histogram(table(spark, sf_dir, "events"), "value", 40), "lo", "hi", digits=6)


@query(
    "contingency_chi2",
    """
WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY ALL),
r AS (SELECT a, sum(o) AS r FROM o GROUP BY a), c AS (SELECT b, sum(o) AS c FROM o GROUP BY b),
n AS (SELECT sum(o)::DOUBLE AS n FROM o),
x AS (SELECT sum((coalesce(o, 0) - r * c / n) ** 2 / (r * c / n)) AS x, any_value(n) AS n
      FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o USING (a, b)),
d AS (SELECT x, n, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS df,
             least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1 AS side FROM x)
SELECT round(x, 6) AS chi2, df, n::BIGINT AS n, round(sqrt(x / (n * side)), 6) AS cramers_v,
       round(exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6), 6) AS p_value
FROM d""",
)
def contingency_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight degrees of freedom, for which the tail is a sum of four terms."""
    found = statistics.contingency_chi2(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(found, "chi2", "cramers_v", "p_value", digits=6)


@query(
    "two_sample_test",
    """
WITH s AS (
  SELECT count(*) FILTER (event_type = 'purchase') AS n_a, count(*) FILTER (event_type = 'click') AS n_b,
         avg(value) FILTER (event_type = 'purchase') AS m_a, avg(value) FILTER (event_type = 'click') AS m_b,
         var_samp(value) FILTER (event_type = 'purchase') AS v_a, var_samp(value) FILTER (event_type = 'click') AS v_b
  FROM events)
SELECT 'purchase' AS group_a, 'click' AS group_b, n_a, n_b, round(m_a - m_b, 6) AS mean_diff,
       round((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS t,
       round((v_a / n_a + v_b / n_b) ** 2
             / ((v_a / n_a) ** 2 / (n_a - 1) + (v_b / n_b) ** 2 / (n_b - 1)), 4) AS df,
       round((m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) AS effect
FROM s""",
)
def two_sample_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = statistics.two_sample_test(table(spark, sf_dir, "events"), "event_type", "value", "purchase", "click")
    return rounded(rounded(test, "mean_diff", "t", "effect", digits=6), "df")


@query(
    "crosstab_shares",
    """
WITH c AS (SELECT o_orderstatus AS a, nullif(o_orderpriority, '5-LOW') AS b, count(*) AS n FROM orders GROUP BY ALL)
SELECT a, b, n, round(n / (sum(n) OVER (PARTITION BY a))::DOUBLE, 6) AS row_share,
       round(n / (sum(n) OVER (PARTITION BY b))::DOUBLE, 6) AS col_share,
       round(n / (sum(n) OVER ())::DOUBLE, 6) AS total_share
FROM c""",
)
def crosstab_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderstatus", null_if(F.col("o_orderpriority"), "5-LOW").alias("priority")
    )
    shares = statistics.crosstab_shares(orders, "o_orderstatus", "priority")
    return rounded(shares, "row_share", "col_share", "total_share", digits=6)


@query(
    "crosstab_wide",
    """
SELECT o_orderpriority AS a, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
       count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def crosstab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.crosstab_wide(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def _sold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sold part with its brand: the sales shrink to parts before they are joined."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"),
        F.sum("l_quantity").alias("quantity"),
        F.count("*").alias("n"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return sold.join(parts, F.col("l_partkey") == F.col("p_partkey"))


@query(
    "compare_items",
    """
WITH t AS (SELECT p_brand AS category, p_partkey AS item, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS revenue,
                  sum(l_quantity)::DOUBLE AS quantity, count(*) AS n
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT category, item, revenue, quantity, n,
       round(revenue / sum(revenue) OVER (PARTITION BY category), 6) AS share,
       row_number() OVER (PARTITION BY category ORDER BY revenue DESC, item) AS rank
FROM t""",
)
def compare_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {
        "revenue": F.sum("revenue").cast("double"),
        "quantity": F.sum("quantity"),
        "n": F.sum("n"),
    }
    sold = _sold_parts(spark, sf_dir)
    return rounded(statistics.compare_items(sold, "p_brand", "l_partkey", metrics, "revenue"), "share", digits=6)


@query(
    "top_items",
    """
WITH t AS (SELECT p_brand AS category, p_partkey AS item, sum(l_quantity::BIGINT)::BIGINT AS metric
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT category, item, metric, row_number() OVER (PARTITION BY category ORDER BY metric DESC, item) AS rank
FROM t QUALIFY rank <= 3""",
)
def top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.sum("quantity").cast("long")
    return statistics.top_items(_sold_parts(spark, sf_dir), "p_brand", "l_partkey", quantity, 3)


# ---- data quality ------------------------------------------------------------------------------


@query(
    "duplicate_rows",
    "SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(table(spark, sf_dir, "documents"), ["text", "lang"])


UNTIDY_SQL = """
t AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 8 THEN lower(c_mktsegment) || ' '
                  WHEN c_nationkey < 12 THEN ' ' || c_mktsegment
                  WHEN c_nationkey = 12 THEN 'N/A' ELSE c_mktsegment END AS segment,
             CASE WHEN c_nationkey = 20 THEN 'none' ELSE c_acctbal::VARCHAR END AS balance,
             CASE WHEN c_nationkey = 3 THEN '?' ELSE '2024-02-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') END AS day,
             CASE WHEN c_nationkey > 5 THEN 'EUR' END AS currency
      FROM customer)"""


def untidy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.when(nation < 8, F.concat(F.lower(segment), F.lit(" ")))
        .when(nation < 12, F.concat(F.lit(" "), segment))
        .when(nation == 12, F.lit("N/A"))
        .otherwise(segment)
        .alias("segment"),
        F.when(nation == 20, F.lit("none")).otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(nation == 3, F.lit("?"))
        .otherwise(F.concat(F.lit("2024-02-"), F.lpad((nation + 1).cast("string"), 2, "0")))
        .alias("day"),
        F.when(nation > 5, F.lit("EUR")).alias("currency"),
    )


@query(
    "inconsistency_report",
    f"""
WITH {UNTIDY_SQL},
v AS (SELECT lower(trim(segment)) AS canonical, count(DISTINCT segment) AS n_variants, count(*) AS n_rows
      FROM t GROUP BY 1 HAVING count(DISTINCT segment) > 1)
SELECT 'segment' AS "column", 'variants' AS issue, canonical, n_variants, n_rows FROM v
UNION ALL SELECT 'balance', 'numeric_text', NULL, 1, count(*) FROM t WHERE try_cast(balance AS DOUBLE) IS NULL
UNION ALL SELECT 'day', 'date_text', NULL, 1, count(*) FROM t WHERE try_cast(day AS DATE) IS NULL
UNION ALL SELECT 'currency', 'constant', 'EUR', 1, count(currency) FROM t""",
)
def inconsistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.inconsistency_report(untidy_customers(spark, sf_dir), ["segment", "balance", "day", "currency"])


CLEANING = [
    Step("trim", ["segment"]),
    Step("null_tokens", ["segment", "balance", "day"], {"tokens": ["n/a", "none", "?"]}),
    Step("cast", ["balance"], {"type": "double"}),
    Step("fill", ["balance"], {"with": "median"}),
    Step("fill", ["currency"], {"with": "mode"}),
    Step("fill", ["day"], {"value": "2024-01-01"}),
    Step("drop_null", ["segment"]),
    Step("dedup", ["c_nationkey", "segment"], {"order": ["c_custkey"]}),
    Step("winsorise", ["balance"], {"low": 0.05, "high": 0.95}),
]

# Step by step: a = tidy text, b = tokens and cast, c = filled, d = complete rows, e = first rows.
CLEAN_STAGES_SQL = f"""
{UNTIDY_SQL},
a AS (SELECT c_custkey, c_nationkey, trim(segment) AS segment, balance, day, currency FROM t),
b AS (SELECT c_custkey, c_nationkey, nullif(segment, 'N/A') AS segment, nullif(balance, 'none')::DOUBLE AS balance,
             nullif(day, '?') AS day, currency FROM a),
c AS (SELECT c_custkey, c_nationkey, segment, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM b)) AS balance,
             coalesce(day, '2024-01-01') AS day, coalesce(currency, 'EUR') AS currency FROM b),
d AS (SELECT * FROM c WHERE segment IS NOT NULL),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_nationkey, segment ORDER BY c_custkey) = 1),
w AS (SELECT quantile_cont(balance, 0.05) AS low, quantile_cont(balance, 0.95) AS high FROM e)"""


@query(
    "clean_dataset",
    f"""
WITH {CLEAN_STAGES_SQL}
SELECT c_custkey, c_nationkey, segment, round(least(greatest(balance, low), high), 4) AS balance, day, currency
FROM e, w""",
)
def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, _ = cleaning.clean_dataset(untidy_customers(spark, sf_dir), CLEANING)
    return rounded(cleaned, "balance")


@query(
    "clean_log",
    f"""
WITH {CLEAN_STAGES_SQL},
n AS (SELECT (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM d) AS d, (SELECT count(*) FROM e) AS e)
SELECT '1. trim segment' AS step, t AS rows_before, t AS rows_after,
       (SELECT count(*) FROM t WHERE segment <> trim(segment)) AS cells_changed FROM n
UNION ALL SELECT '2. null_tokens segment, balance, day', t, t,
  (SELECT count(*) FILTER (segment = 'N/A') + count(*) FILTER (balance = 'none') + count(*) FILTER (day = '?') FROM a)
  FROM n
UNION ALL SELECT '3. cast balance', t, t, 0 FROM n
UNION ALL SELECT '4. fill balance', t, t, (SELECT count(*) FROM b WHERE balance IS NULL) FROM n
UNION ALL SELECT '5. fill currency', t, t, (SELECT count(*) FROM b WHERE currency IS NULL) FROM n
UNION ALL SELECT '6. fill day', t, t, (SELECT count(*) FROM b WHERE day IS NULL) FROM n
UNION ALL SELECT '7. drop_null segment', t, d, 0 FROM n
UNION ALL SELECT '8. dedup c_nationkey, segment', d, e, 0 FROM n
UNION ALL SELECT '9. winsorise balance', e, e, (SELECT count(*) FROM e, w WHERE balance < low OR balance > high) FROM n""",
)
def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = cleaning.clean_dataset(untidy_customers(spark, sf_dir), CLEANING)
    return log


@query(
    "feature_columns",
    """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority, year(o_orderdate) AS o_orderdate_year,
       month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day,
       isodow(o_orderdate) AS o_orderdate_weekday, quarter(o_orderdate) AS o_orderdate_quarter,
       (o_totalprice >= 1000)::INT + (o_totalprice >= 100000)::INT + (o_totalprice >= 250000)::INT AS price_band,
       o_totalprice / nullif(o_custkey, 0) AS price_per_key,
       (o_orderstatus = 'F')::INT AS is_0, (o_orderstatus = 'O')::INT AS is_1
FROM orders""",
)
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = cleaning.feature_columns(
        table(spark, sf_dir, "orders"),
        dates=["o_orderdate"],
        bins={"price_band": ("o_totalprice", [1000.0, 100000.0, 250000.0])},
        ratios={"price_per_key": ("o_totalprice", "o_custkey")},
        flags={"is_": ("o_orderstatus", ["F", "O"])},
    )
    parts = ["year", "month", "day", "weekday", "quarter"]
    return featured.withColumns({f"o_orderdate_{p}": F.col(f"o_orderdate_{p}").cast("long") for p in parts})


# ---- periods -----------------------------------------------------------------------------------

# Orders of two statuses leave out every January, so that the calendar has gaps to fill.
MONTHS_SQL = """
o AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS period,
             o_totalprice::DECIMAL(18, 2) AS price
      FROM orders WHERE o_orderpriority <> '1-URGENT' OR month(o_orderdate) <> 1),
s AS (SELECT series, period, sum(price) AS total FROM o GROUP BY ALL),
span AS (SELECT series, min(period) AS a, max(period) AS b FROM s GROUP BY series),
cal AS (SELECT series, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS period FROM span),
m AS (SELECT cal.series, cal.period, coalesce(total, 0)::DOUBLE AS total
      FROM cal LEFT JOIN s ON s.series = cal.series AND s.period = cal.period)"""


def _priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where((F.col("o_orderpriority") != "1-URGENT") | (F.month("o_orderdate") != 1))


ORDER_VALUE = "decimal(18,2)"


@query(
    "trend",
    f"""
WITH {MONTHS_SQL}
SELECT series, period, round(total, 2) AS total, round(lag(total) OVER w, 2) AS prev,
       round(total - lag(total) OVER w, 2) AS change,
       round(avg(total) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma3
FROM m WINDOW w AS (PARTITION BY series ORDER BY period)""",
)
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_totalprice").cast(ORDER_VALUE)
    found = periods.trend(_priced_orders(spark, sf_dir), F.col("o_orderpriority"), F.col("o_orderdate"), value)
    return rounded(found, "total", "prev", "change", "ma3", digits=2)


@query(
    "seasonal_index",
    f"""
WITH {MONTHS_SQL}
SELECT series, month(period) AS month,
       round(avg(total) / (SELECT avg(total) FROM m AS x WHERE x.series = m.series), 6) AS "index"
FROM m GROUP BY series, month(period)""",
)
def seasonal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_totalprice").cast(ORDER_VALUE)
    found = periods.seasonal_index(
        _priced_orders(spark, sf_dir), F.col("o_orderpriority"), F.col("o_orderdate"), value
    )
    return rounded(found, "index", digits=6)


# ---- matching ----------------------------------------------------------------------------------


def _solvent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit: some orders are left without a customer."""
    return (
        table(spark, sf_dir, "customer")
        .where("c_acctbal > 0")
        .select(F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment")
    )


def _keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        null_if(F.col("o_custkey"), 7).alias("custkey"), "o_orderkey", "o_totalprice"
    )


JOINED_SQL = """
WITH c AS (SELECT c_custkey AS custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0),
o AS (SELECT nullif(o_custkey, 7) AS custkey, o_orderkey, o_totalprice FROM orders)"""


@query("relate_datasets", JOINED_SQL + " SELECT * FROM o JOIN c USING (custkey)")
def relate_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relate_datasets(_keyed_orders(spark, sf_dir), _solvent(spark, sf_dir), ["custkey"])


@query("relate_datasets_left", JOINED_SQL + " SELECT * FROM o LEFT JOIN c USING (custkey)")
def relate_datasets_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relate_datasets(_keyed_orders(spark, sf_dir), _solvent(spark, sf_dir), ["custkey"], "left")


@query("relate_datasets_semi", JOINED_SQL + " SELECT * FROM c SEMI JOIN o USING (custkey)")
def relate_datasets_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relate_datasets(_solvent(spark, sf_dir), _keyed_orders(spark, sf_dir), ["custkey"], "left_semi")


@query("relate_datasets_anti", JOINED_SQL + " SELECT * FROM o ANTI JOIN c USING (custkey)")
def relate_datasets_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relate_datasets(_keyed_orders(spark, sf_dir), _solvent(spark, sf_dir), ["custkey"], "left_anti")


@query(
    "key_coverage",
    JOINED_SQL
    + """,
a AS (SELECT custkey, count(*) AS n FROM o GROUP BY custkey), b AS (SELECT custkey, count(*) AS n FROM c GROUP BY custkey)
SELECT (SELECT count(*) FROM o WHERE custkey IN (SELECT custkey FROM c)) AS matched_left,
       (SELECT count(*) FROM o ANTI JOIN c USING (custkey)) AS left_only,
       (SELECT count(*) FROM c ANTI JOIN o USING (custkey)) AS right_only,
       (SELECT count(*) FROM a WHERE n > 1 AND custkey IS NOT NULL) AS left_dup_keys,
       (SELECT count(*) FROM b WHERE n > 1 AND custkey IS NOT NULL) AS right_dup_keys""",
)
def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_coverage(_keyed_orders(spark, sf_dir), _solvent(spark, sf_dir), ["custkey"])
