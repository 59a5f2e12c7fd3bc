"""Queries for segments, the chi-squared tree, its policy and the streaming profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.operators.profile import n_unique
from lodeglass.plans import chaid, segments
from lodeglass.session import materialise, scratch_path
from lodeglass.streaming import incremental
from lodeglass.workload.registry import query, rounded, table
from lodeglass.workload.tree_sql import tree_sql

# ---- segments ----------------------------------------------------------------------------------


def _score_sql(column: str) -> str:
    return " + ".join(f"({column} > {column}_{i})::INT" for i in (2, 4, 6, 8)) + " + 1"


@query(
    "segment_quantile",
    f"""
WITH c AS (SELECT o_custkey AS key, max(o_orderdate)::DATE AS last, count(*) AS frequency,
                  sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS monetary FROM orders GROUP BY o_custkey),
v AS (SELECT key, datediff('day', last, (SELECT max(last) FROM c)) AS recency, frequency, monetary FROM c),
q AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.{i}) AS {c}_{i}' for c in ('recency', 'frequency', 'monetary')
                        for i in (2, 4, 6, 8))} FROM v),
s AS (SELECT key, recency, frequency, monetary, {_score_sql('recency')} AS r, {_score_sql('frequency')} AS f,
             {_score_sql('monetary')} AS m FROM v, q)
SELECT *, r || '' || f || '' || m AS segment FROM s""",
)
def segment_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return segments.segment_quantile(
        orders, "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)")
    )


def _kmeans_sql(points: str, k: int, steps: int = 20, runs: int = 8) -> str:
    """CTEs ``c`` (the last centres of the best run by place, numbered in their order) and ``assigned``: Lloyd's steps over
    ``p`` (key, place, v)."""
    return f"""
WITH RECURSIVE {points},
seeds AS (
  SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY md5('42:' || run || ':' || key::VARCHAR), key) - 1 AS cluster
  FROM (SELECT DISTINCT key FROM p), (SELECT unnest(range({runs})) AS run)),
s AS (
  SELECT 0 AS step, run, cluster, place, v AS c FROM p JOIN seeds USING (key) WHERE cluster < {k}
  UNION ALL
  SELECT step + 1, run, cluster, p.place, avg(p.v) FROM p JOIN (
    SELECT step, run, key, min({{'d': d, 'c': cluster}}).c AS cluster FROM (
      SELECT step, run, key, cluster, sum((v - c) * (v - c)) AS d FROM s JOIN p USING (place) WHERE step < {steps}
      GROUP BY step, run, key, cluster) GROUP BY step, run, key) USING (key)
  GROUP BY step, run, cluster, p.place),
near AS (
  SELECT run, key, min({{'d': d, 'c': cluster}}) AS m FROM (
    SELECT run, key, cluster, sum((v - c) * (v - c)) AS d FROM s JOIN p USING (place) WHERE step = {steps} GROUP BY run, key, cluster)
  GROUP BY run, key),
best AS (SELECT run FROM near GROUP BY run ORDER BY sum(m.d), run LIMIT 1),
named AS (SELECT cluster, row_number() OVER (ORDER BY centre) - 1 AS name FROM (
  SELECT cluster, list(c ORDER BY place) AS centre FROM s JOIN best USING (run) WHERE step = {steps} GROUP BY cluster)),
c AS (SELECT name AS cluster, place, c FROM s JOIN best USING (run) JOIN named USING (cluster) WHERE step = {steps}),
assigned AS (SELECT key, name AS cluster FROM near JOIN best USING (run) JOIN named ON named.cluster = near.m.c)"""


EMBEDDED_SQL = """
p AS (SELECT vec_id AS key, unnest(range(0, len(embedding))) AS place, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
BUYERS_SQL = """
b AS (SELECT o_custkey AS key, count(*)::DOUBLE AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
p AS (SELECT key, 0 AS place, (n - (SELECT avg(n) FROM b)) / (SELECT stddev_samp(n) FROM b) AS v FROM b
      UNION ALL SELECT key, 1, (total - (SELECT avg(total) FROM b)) / (SELECT stddev_samp(total) FROM b) FROM b)"""


@query("segment_kmeans", _kmeans_sql(EMBEDDED_SQL, 5) + " SELECT key, cluster::INT AS cluster FROM assigned")
def segment_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, _ = segments.segment_kmeans(table(spark, sf_dir, "embeddings"), "vec_id", ["embedding"], k=5)
    return assigned


@query(
    "segment_kmeans_centres",
    _kmeans_sql(BUYERS_SQL, 4)
    + """ SELECT c.cluster::INT AS cluster, a.n, round(max(c) FILTER (place = 0), 6) AS n_orders, round(max(c) FILTER (place = 1), 6) AS total
FROM c JOIN (SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster) AS a ON a.cluster = c.cluster GROUP BY c.cluster, a.n""",
)
def segment_kmeans_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")
    )
    _, centres = segments.segment_kmeans(customers, "o_custkey", ["n_orders", "total"], k=4)
    places = [F.round(F.col("centre")[i], 6).alias(n) for i, n in enumerate(("n_orders", "total"))]
    return centres.select("cluster", "n", *places)


# ---- the tree ----------------------------------------------------------------------------------



def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a yes/no target: is the price above 60,000?"""
    return table(spark, sf_dir, "lineitem").withColumn("dear", (F.col("l_extendedprice") > 60000).cast("int"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a few counts of their text and a yes/no target: is it long?

    Written once: the tree passes over its rows several times and should not read the texts again.
    """
    counted = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.regexp_count("text", F.lit("[.]")).alias("n_stops"),
        F.regexp_count("text", F.lit("[#%*]{3}")).alias("n_marks"),
        (F.col("n_chars") > 1500).cast("int").alias("long"),
    )
    return materialise(counted)


PREDICTORS = ["n_lines", "n_stops", "n_marks", "lang"]


def _tree(texts: DataFrame) -> chaid.Tree:
    return chaid.chaid_tree(texts, "long", 1, PREDICTORS, max_depth=2)


@query(
    "chaid_level0",
    """
WITH q AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))
                    AS cuts FROM lineitem),
t AS (SELECT (l_extendedprice > 60000)::INT AS hit, l_returnflag,
             'b' || lpad(len(list_filter(cuts, lambda c: l_quantity >= c))::VARCHAR, 2, '0') AS bin FROM lineitem, q)
SELECT 'l_quantity' AS predictor, bin AS category, count(*) AS n, round(avg(hit), 6) AS rate FROM t GROUP BY bin
UNION ALL
SELECT 'l_returnflag', l_returnflag, count(*), round(avg(hit), 6) FROM t GROUP BY l_returnflag""",
)
def chaid_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    categories, _ = chaid.categories_of(lines, ["l_quantity", "l_returnflag"])
    return rounded(chaid.category_rates(lines, F.col("dear"), categories), "rate", digits=6)


TEXT_TREE_SQL = "WITH RECURSIVE " + tree_sql(
    "documents", "doc_id", "n_chars > 1500",
    {
        "n_lines": "len(string_split(text, chr(10)))",
        "n_stops": "len(regexp_extract_all(text, '[.]'))",
        "n_marks": "len(regexp_extract_all(text, '[#%*]{3}'))",
    },
    {"lang": "lang"},
)
DECISION_SQL = "CASE WHEN rate < 0.2 THEN 'approve' WHEN rate >= 0.6 THEN 'decline' ELSE 'review' END AS decision"


@query(
    "chaid_tree",
    TEXT_TREE_SQL + "SELECT node_id, parent_id, depth, path, split_column, categories, n, round(rate, 6) AS rate, "
    "round(adj_p, 10) AS adj_p FROM nodes",
)
def chaid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    nodes = chaid.tree_frame(texts, _tree(texts)).withColumn("categories", F.array_join("categories", ", "))
    return rounded(rounded(nodes, "rate", digits=6), "adj_p", digits=10)


@query(
    "chaid_tree_labels",
    "WITH RECURSIVE "
    + tree_sql(
        "documents JOIN labels USING (doc_id)", "doc_id", "quality = 1",
        {
            "n_lines": "len(string_split(text, chr(10)))",
            "n_marks": "len(regexp_extract_all(text, '[#%*]{3}'))",
            "toxic": "toxic",
        },
        {"lang": "lang"}, min_leaf=10, depth=3,
    )
    + "SELECT node_id, parent_id, depth, path, split_column, categories, n, round(1 - rate, 6) AS rate, "
    "round(adj_p, 10) AS adj_p FROM nodes",
)
def chaid_tree_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells labelled documents of low quality from the others: a tree of three levels."""
    labels = table(spark, sf_dir, "labels")
    texts = _texts(spark, sf_dir).join(labels, "doc_id")
    predictors = ["n_lines", "n_marks", "lang", "toxic"]
    tree = chaid.chaid_tree(texts, "quality", 0, predictors, min_leaf=10)
    nodes = chaid.tree_frame(texts, tree).withColumn("categories", F.array_join("categories", ", "))
    return rounded(rounded(nodes, "rate", digits=6), "adj_p", digits=10)


@query(
    "risk_policy",
    TEXT_TREE_SQL + f"SELECT node_id AS leaf_id, path, n, round(rate, 6) AS rate, {DECISION_SQL} FROM nodes WHERE leaf",
)
def risk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return rounded(chaid.risk_policy(texts, _tree(texts), approve_below=0.2, decline_from=0.6), "rate", digits=6)


@query(
    "risk_policy_totals",
    """
SELECT count(*) AS n, count(*) FILTER (n_chars > 1500) AS hits FROM documents""",
)
def risk_policy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves share out all rows and all hits, each exactly once."""
    texts = _texts(spark, sf_dir)
    policy = chaid.risk_policy(texts, _tree(texts), approve_below=0.2, decline_from=0.6)
    return policy.agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("n") * F.col("rate"))).cast("long").alias("hits"),
    )


@query(
    "risk_policy_applied",
    TEXT_TREE_SQL + f"SELECT key, leaf_id, {DECISION_SQL} FROM routed JOIN nodes ON node_id = leaf_id",
)
def risk_policy_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf and decision."""
    texts = _texts(spark, sf_dir)
    return chaid.apply_policy(texts, "doc_id", _tree(texts), approve_below=0.2, decline_from=0.6)


# A tree that SQL can follow: three classes and yes/no predictors leave nothing to merge and two
# degrees of freedom, whose tail is exp(-x / 2).
SPLIT_SQL = """
t AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 2500 THEN 'middle' ELSE 'long' END AS size,
             CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END AS english,
             CASE WHEN regexp_matches(text, '[#%*]{3}') THEN 'yes' ELSE 'no' END AS marked,
             CASE WHEN len(string_split(text, chr(10))) > 8 THEN 'yes' ELSE 'no' END AS tall FROM documents),
l AS (SELECT 'english' AS p, english AS c, size FROM t UNION ALL SELECT 'marked', marked, size FROM t
      UNION ALL SELECT 'tall', tall, size FROM t),
o AS (SELECT p, c, size, count(*) AS o FROM l GROUP BY ALL),
r AS (SELECT p, c, sum(o)::DOUBLE AS r FROM o GROUP BY ALL), k AS (SELECT p, size, sum(o) AS k FROM o GROUP BY ALL),
x AS (SELECT r.p, sum((coalesce(o, 0) - r * k / n) ** 2 / (r * k / n)) AS x, count(DISTINCT r.c) AS kinds
      FROM r JOIN k ON r.p = k.p CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM t)
      LEFT JOIN o ON o.p = r.p AND o.c = r.c AND o.size = k.size GROUP BY r.p),
best AS (SELECT p, exp(-x / 2) AS adj_p FROM x WHERE kinds = 2 AND exp(-x / 2) <= 0.05 ORDER BY x DESC, p LIMIT 1),
leaf AS (SELECT row_number() OVER (ORDER BY c) AS leaf_id, l.p, c, adj_p, count(*) AS n,
                count(*) FILTER (size = 'long') / count(*)::DOUBLE AS rate
         FROM l JOIN best ON l.p = best.p GROUP BY l.p, c, adj_p)"""


def _sized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def yes(condition: Column) -> Column:
        return F.when(condition, "yes").otherwise("no")

    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 2500, "middle").otherwise("long")
    return materialise(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            size.alias("size"),
            yes(F.col("lang") == "en").alias("english"),
            yes(F.rlike("text", F.lit("[#%*]{3}"))).alias("marked"),
            yes(F.size(F.split("text", "\n")) > 8).alias("tall"),
        )
    )


def _split(texts: DataFrame) -> chaid.Tree:
    return chaid.chaid_tree(texts, "size", "long", ["english", "marked", "tall"], max_depth=1, min_leaf=1)


@query(
    "chaid_split",
    f"""
WITH {SPLIT_SQL}
SELECT 0 AS node_id, NULL::INT AS parent_id, 0 AS depth, 'all' AS path, NULL::VARCHAR AS split_column,
       '' AS categories, count(*) AS n, round(count(*) FILTER (size = 'long') / count(*)::DOUBLE, 6) AS rate,
       NULL::DOUBLE AS adj_p FROM t
UNION ALL SELECT leaf_id::INT, 0, 1, p || ' in {{' || c || '}}', p, c, n, round(rate, 6), round(adj_p, 12) FROM leaf""",
)
def chaid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sized_texts(spark, sf_dir)
    nodes = chaid.tree_frame(texts, _split(texts)).withColumn("categories", F.array_join("categories", ", "))
    return rounded(rounded(nodes, "rate", digits=6), "adj_p", digits=12)


@query(
    "risk_policy_split",
    f"""
WITH {SPLIT_SQL}
SELECT leaf_id::INT AS leaf_id, p || ' in {{' || c || '}}' AS path, n, round(rate, 6) AS rate,
       CASE WHEN rate < 0.1 THEN 'approve' WHEN rate >= 0.3 THEN 'decline' ELSE 'review' END AS decision FROM leaf""",
)
def risk_policy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sized_texts(spark, sf_dir)
    return rounded(chaid.risk_policy(texts, _split(texts), approve_below=0.1, decline_from=0.3), "rate", digits=6)


@query(
    "risk_policy_split_applied",
    f"""
WITH {SPLIT_SQL},
d AS (SELECT doc_id, unnest(['english', 'marked', 'tall']) AS p, unnest([english, marked, tall]) AS c FROM t)
SELECT doc_id AS key, leaf_id::INT AS leaf_id,
       CASE WHEN rate < 0.1 THEN 'approve' WHEN rate >= 0.3 THEN 'decline' ELSE 'review' END AS decision
FROM d JOIN leaf USING (p, c)""",
)
def risk_policy_split_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sized_texts(spark, sf_dir)
    return chaid.apply_policy(texts, "doc_id", _split(texts), approve_below=0.1, decline_from=0.3)


# ---- streams -----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return incremental.file_stream(spark, path, spark.read.parquet(path).schema)


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, state = scratch_path(spark, "incremental"), scratch_path(spark, "incremental_state")
    incremental.incremental_profile(_event_stream(spark, sf_dir), ["event_id", "user_id", "value"], out, state)
    return incremental.read_profile(spark, out)


@query(
    "incremental_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS null_count, "
        f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, "
        f"max({c})::DOUBLE AS max FROM events"
        for c in ["event_id", "user_id", "value"]
    ),
)
def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_profiled(spark, sf_dir).drop("approx_unique", "min_exact", "max_exact"), "mean", "std")


UNIQUE = {"user_group": "user_id % 97", "event_hour": "hour(ts)", "value_class": "CAST(floor(value / 10) AS BIGINT) % 50"}
WHOLE = ["event_id", "user_id", "value"]


def _unique_sql() -> str:
    few = [(name, sql, f"count(DISTINCT {sql})") for name, sql in UNIQUE.items()]
    parts = [
        f"SELECT '{name}' AS \"column\", count({sql}) AS n, {found} AS approx_unique, count(DISTINCT {sql}) AS n_unique, "
        f"true AS close FROM events"
        for name, sql, found in [*few, *[(c, c, "any_value(NULL::BIGINT)") for c in WHOLE]]
    ]
    return " UNION ALL ".join(parts)


@query("incremental_unique", _unique_sql())
def incremental_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of merged sketches beside the exact ones, of whole columns and of classes made from them.

    Of a few hundred values a sketch forgets none: ``approx_unique`` is exact there, and left out where it is an estimate.
    ``close``: the sketch is within 5 % of the exact count.
    """
    measures = {**UNIQUE, **{c: c for c in WHOLE}}

    def measured(events: DataFrame) -> DataFrame:
        return events.select(*[F.expr(sql).alias(name) for name, sql in measures.items()])

    out, state = scratch_path(spark, "incremental"), scratch_path(spark, "incremental_state")
    incremental.incremental_profile(measured(_event_stream(spark, sf_dir)), list(measures), out, state)
    exact = n_unique(measured(table(spark, sf_dir, "events")))
    both = incremental.read_profile(spark, out).join(exact, "column")
    close = F.abs(F.col("approx_unique") - F.col("n_unique")) <= 0.05 * F.col("n_unique")
    small = F.when(F.col("column").isin(list(UNIQUE)), F.col("approx_unique")).alias("approx_unique")
    return both.select("column", "n", small, "n_unique", close.alias("close"))


@query(
    "windowed_counts",
    """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n,
       date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) AS closed FROM events GROUP BY ALL""",
)
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of all events, and whether the newest event is a day past the end of the day."""
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "windows_state")
    return incremental.windowed_counts(_event_stream(spark, sf_dir), "ts", "event_type", out, state)


@query(
    "windowed_counts_by_arrival",
    """
SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n,
       date_trunc('hour', ts) + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events) AS closed FROM events GROUP BY ALL""",
)
def windowed_counts_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of all events, which arrive in five files against the order of time, one a batch."""
    path = scratch_path(spark, "arrivals")
    events = table(spark, sf_dir, "events")
    events.repartitionByRange(5, F.col("ts").desc()).write.parquet(path)
    stream = incremental.file_stream(spark, path, events.schema, files_per_batch=1)
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "windows_state")
    return incremental.windowed_counts(stream, "ts", "event_type", out, state, "1 hour", "1 day", fan=3)
