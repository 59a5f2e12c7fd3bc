"""Queries over texts: documents, prompts, guidance, replies, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions import text as tx
from lodeglass.operators import documents, replies
from lodeglass.operators.profile import dataset_shape, text_profile
from lodeglass.operators.profile import joined_names as profile_names
from lodeglass.operators.ordering import number_within
from lodeglass.plans import overview
from lodeglass.session import scratch_path
from lodeglass.sinks import exports
from lodeglass.sources import tables as sources
from lodeglass.workload.registry import TABLES, query, rounded, table

# ---- documents ---------------------------------------------------------------------------------


@query(
    "text_ingest",
    """
SELECT 'doc_' || doc_id || '.TXT' AS name, 'txt' AS file_type, text, length(text) AS text_length FROM documents""",
)
def text_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    return sources.text_ingest(table(spark, sf_dir, "documents"), name, "text")


@query(
    "fragment_concat",
    """
SELECT conv_id AS doc, turn // 1000 AS part, string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY ALL""",
)
def fragment_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.fragment_concat(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    "fragment_concat_pages",
    """
SELECT conv_id AS doc, turn // 1000 AS part, string_agg(text || chr(10), '' ORDER BY turn) AS text
FROM conversations WHERE text <> '' GROUP BY ALL""",
)
def fragment_concat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.fragment_concat(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "pages")


@query(
    "text_profile",
    """
SELECT lang AS "group", count(*) AS n_docs, min(length(text)) AS min_len, round(avg(length(text)), 4) AS avg_len,
       max(length(text)) AS max_len, sum(length(text))::BIGINT AS total_len
FROM documents GROUP BY lang""",
)
def text_profile_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text_profile(table(spark, sf_dir, "documents"), "text", F.col("lang")), "avg_len")


@query("export_texts_json", "SELECT 'doc_' || doc_id AS name, text FROM documents")
def export_texts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export_texts")
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("name"), "text")
    exports.export_texts_json(texts, path)
    return sources.read_json(spark, path, texts.schema)


# ---- text expressions --------------------------------------------------------------------------


@query(
    "snippet",
    """
SELECT doc_id AS key, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet
FROM documents""",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), tx.snippet(F.col("text"), 200).alias("snippet")
    )


@query(
    "escape_braces",
    "SELECT event_id AS key, replace(replace(props, '{', '{{'), '}', '}}') AS escaped FROM events",
)
def escape_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"), tx.escape_braces(F.col("props")).alias("escaped")
    )


@query(
    "forbidden_code_scan",
    """
WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'import subprocess' || chr(10) || props
                                            WHEN 'click' THEN 'x = ' || props || '; os.system(x)'
                                            WHEN 'view' THEN NULL ELSE 'y = ' || props END AS code FROM events)
SELECT event_id AS key, NOT contains(code, 'os.system') AND NOT contains(code, 'subprocess') AS allowed FROM t""",
)
def forbidden_code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    code = (
        F.when(kind == "error", F.concat(F.lit("import subprocess\n"), props))
        .when(kind == "click", F.concat(F.lit("x = "), props, F.lit("; os.system(x)")))
        .when(kind != "view", F.concat(F.lit("y = "), props))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"), tx.code_allowed(code).alias("allowed")
    )


@query(
    "usable_response",
    """
WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Error: ' || props WHEN 'view' THEN ''
                                            WHEN 'signup' THEN NULL ELSE props END AS reply FROM events)
SELECT * FROM t WHERE length(reply) > 0 AND NOT starts_with(reply, 'Error:')""",
)
def usable_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    reply = (
        F.when(kind == "error", F.concat(F.lit("Error: "), props))
        .when(kind == "view", F.lit(""))
        .when(kind != "signup", props)
    )
    events = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return events.where(tx.usable_response(F.col("reply")))


@query(
    "missing_prerequisites",
    """
SELECT event_id AS key, concat_ws(', ', CASE WHEN event_type = 'error' THEN 'Plan' END,
       CASE WHEN value < 50 THEN 'Data Summary' END, CASE WHEN props = '' OR value > 100 THEN 'Results' END) AS missing
FROM events""",
)
def missing_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    required = {
        "Plan": F.nullif(F.col("event_type"), F.lit("error")),
        "Data Summary": F.when(F.col("value") >= 50, F.col("event_type")),
        "Results": F.when(F.col("value") > 100, F.lit("")).otherwise(F.col("props")),
    }
    return events.select(F.col("event_id").alias("key"), tx.missing_labels(required).alias("missing"))


@query(
    "extension_of",
    r"""
WITH t AS (SELECT url AS name FROM pages UNION ALL SELECT url || '/.hidden' FROM pages
           UNION ALL SELECT url || '/Report.final.CSV' FROM pages)
SELECT name, lower(regexp_extract(name, '[^/.][^/]*?(\.[^./]*)$', 1)) AS ext FROM t""",
)
def extension_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(
        F.array("url", F.concat("url", F.lit("/.hidden")), F.concat("url", F.lit("/Report.final.CSV")))
    )
    return table(spark, sf_dir, "pages").select(names.alias("name")).select(
        "name", tx.extension_of(F.col("name")).alias("ext")
    )


TEMPLATE = (
    "Problem: {problem}\nKeep {{braces}} as they are.\nPage {page} at {url}\nStart of the page:\n{sample}\nEnd."
)


@query(
    "prompt_fill",
    """
SELECT page_id AS key, 'Problem: why {url} matters' || chr(10) || 'Keep {braces} as they are.' || chr(10) || 'Page '
       || page_id || ' at ' || url || chr(10) || 'Start of the page:' || chr(10)
       || html || chr(10) || 'End.' AS prompt
FROM pages""",
)
def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {
        "problem": F.lit("why {url} matters"),
        "page": F.col("page_id"),
        "url": F.col("url"),
        "sample": F.col("html"),
    }
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("key"), tx.fill_template(TEMPLATE, values).alias("prompt")
    )


# ---- guidance and replies ----------------------------------------------------------------------

# Every line of a document becomes a task line, numbered 1 to 3 over and over, followed by a note
# line; repeated lines therefore give repeated blocks. Every other language uses bare headers.
GUIDANCE_SQL = """
WITH d AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, lang, source FROM d),
b AS (SELECT doc_id, i, regexp_replace(
          CASE WHEN lang IN ('en', 'fr') THEN '**Task ' || ((i - 1) % 3 + 1) || ':** '
               ELSE 'task ' || ((i - 1) % 3 + 1) || '.: ' END || line || chr(10) || '  - from ' || source,
          '\\s+$', '') AS task FROM g),
u AS (SELECT doc_id, task, min(i) AS i FROM b GROUP BY ALL),
n AS (SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, task FROM u)
SELECT key, pos, task FROM n
UNION ALL SELECT key, max(pos) + 1, 'Manually define task below' FROM n GROUP BY key"""


@query("task_blocks", GUIDANCE_SQL)
def task_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lines(line, i):
        number = (i % 3 + 1).cast("string")
        header = F.when(
            F.col("lang").isin("en", "fr"), F.concat(F.lit("**Task "), number, F.lit(":** "))
        ).otherwise(F.concat(F.lit("task "), number, F.lit(".: ")))
        return F.concat(header, line, F.lit("\n  - from "), "source")

    guidance = F.concat(
        F.lit("1. Refine the plan\nSome words first.\n\n"),
        F.array_join(F.transform(F.split("text", "\n"), lines), "\n\n"),
        F.lit("\n   5. Develop Narrative: a story\n**Task 9:** never seen"),
    )
    texts = table(spark, sf_dir, "documents").select("doc_id", guidance.alias("guidance"))
    return replies.task_blocks(texts, "doc_id", "guidance")


@query(
    "response_sections",
    """
SELECT event_id AS key,
       CASE WHEN event_type = 'signup' THEN 'Error: No response from Analyst.'
            WHEN event_type = 'view' THEN 'Could not parse ''approach'' section.'
            WHEN event_type = 'click' THEN 'second thoughts' ELSE 'Look at ' || event_type || '.' END AS approach,
       CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'view' THEN 'Could not parse ''code'' section.'
            ELSE 'df = ' || props || chr(10) || 'print(df)' END AS code,
       CASE WHEN event_type = 'signup' THEN '' ELSE 'User ' || user_id || ' did ' || event_type || '.' END
           AS results_text,
       CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'error' THEN 'Could not parse ''insights'' section.'
            ELSE 'Insights: none' || chr(10) || 'really' END AS insights
FROM events""",
)
def response_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    approach = F.concat(F.lit("Intro words\n1.  **Approach:** Look at "), kind, F.lit(".\n"))
    code = F.concat(
        F.lit("2. **Python Code:**\n\n```python\ndf = "), "props", F.lit("\nprint(df)\n```\n")
    )
    results = F.concat(F.lit("**RESULTS:** User "), F.col("user_id").cast("string"), F.lit(" did "), kind, F.lit(".\n"))
    insights = F.lit("\n  Key Insights: **Insights: none\nreally**  \n")
    reply = (
        F.when(kind == "signup", F.lit(""))
        .when(kind == "view", F.concat(results, insights))
        .when(kind == "error", F.concat(approach, code, results))
        .when(kind == "click", F.concat(approach, code, results, insights, F.lit("approach: second thoughts")))
        .otherwise(F.concat(approach, code, results, insights))
    )
    events = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return replies.response_sections(events, "event_id", "reply")


@query(
    "ordered_dedup",
    """
SELECT conv_id AS key, CASE WHEN role = 'system' THEN 9223372036854775807 ELSE min(turn) END AS pos, role AS value
FROM conversations GROUP BY conv_id, role""",
)
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.ordered_dedup(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "system")


@query(
    "ordered_dedup_array",
    """
WITH d AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents),
w AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d),
u AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY ALL)
SELECT doc_id AS key, string_agg(word, ' ' ORDER BY word = 'the', i) AS value FROM u GROUP BY doc_id""",
)
def ordered_dedup_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = replies.distinct_in_order(F.split("text", " "), "the")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.array_join(words, " ").alias("value")
    )


@query(
    "conversation_log",
    "SELECT conv_id, turn + 1 AS seq, role, text AS content FROM conversations",
)
def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two goes; the log numbers the second on from the first."""
    path = scratch_path(spark, "conversation_log")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    exports.append_conversations(said.where("turn < 2"), path, ["turn"])
    exports.append_conversations(said.where("turn >= 2"), path, ["turn"])
    return documents.conversation_log(exports.read_conversations(spark, path), "conv_id", "seq", "role", "content")


@query(
    "conversation_export",
    "SELECT conv_id, turn + 1 AS seq, role, text AS content FROM conversations",
)
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole history as JSON, read back; its one append was tried twice under the same name."""
    path, copy = scratch_path(spark, "conversation_log"), scratch_path(spark, "conversation_json")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    for _ in range(2):
        exports.append_conversations(said, path, ["turn"], batch="all turns")
    exports.export_conversations_json(exports.read_conversations(spark, path), copy)
    return sources.read_json(spark, copy, exports.read_conversations(spark, path).schema)


@query(
    "conversation_rollup",
    "SELECT conv_id, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL",
)
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return documents.conversation_rollup(documents.conversation_log(said, "conv_id", "turn", "role", "text"))


# ---- results, reports and context --------------------------------------------------------------

# One result per order status and month; the status is the project.
RESULTS_SQL = """
results AS (
  SELECT o_orderstatus AS project, strftime(o_orderdate, '%Y-%m') AS month,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY strftime(o_orderdate, '%Y-%m')) AS seq,
         count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::VARCHAR AS total
  FROM orders GROUP BY o_orderstatus, strftime(o_orderdate, '%Y-%m'))"""


def monthly_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, task, files, approach, code, results_text, insights, plot_file and month."""
    orders = table(spark, sf_dir, "orders")
    months = orders.groupBy(
        F.col("o_orderstatus").alias("project"), F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    january = F.endswith("month", F.lit("-01"))
    return months.select(
        "project",
        "month",
        F.when(~january, F.concat(F.lit("Orders of "), "month", F.lit(", counted and summed over all customers")))
        .alias("task"),
        F.array(F.lit("orders.parquet"), F.concat("project", F.lit(".csv"))).alias("files"),
        F.lit("  Count and sum the month's orders.\n").alias("approach"),
        F.when(january, F.lit("")).otherwise(F.concat(F.lit("month = '"), "month", F.lit("'\n"))).alias("code"),
        F.concat(F.col("n").cast("string"), F.lit(" orders worth "), F.col("total").cast("string")).alias(
            "results_text"
        ),
        F.when(F.col("n") > 60, F.lit("A busy month.")).alias("insights"),
        F.when(january, F.concat(F.lit("plot_"), "month", F.lit(".html"))).alias("plot_file"),
    )


def numbered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_within(monthly_results(spark, sf_dir), ["project"], [F.col("month")], "seq")


RESULT_FIELDS_SQL = """
  CASE WHEN month NOT LIKE '%-01' THEN 'Orders of ' || month || ', counted and summed over all customers' END AS task,
  'orders.parquet, ' || project || '.csv' AS files, '  Count and sum the month''s orders.' || chr(10) AS approach,
  CASE WHEN month LIKE '%-01' THEN '' ELSE 'month = ''' || month || '''' || chr(10) END AS code,
  n || ' orders worth ' || total AS results_text, CASE WHEN n > 60 THEN 'A busy month.' END AS insights"""

BLOCK_SQL = """
blocks AS (
  SELECT project, seq, concat_ws(chr(10),
    '### Task ' || seq || ': ' || coalesce(task, 'Task ' || seq), '**Files Used:** ' || files,
    '**Approach:**', trim(approach, ' ' || chr(10)),
    CASE WHEN code <> '' THEN '**Python Code:**' || chr(10) || '```python' || chr(10) || trim(code, chr(10))
         || chr(10) || '```' END,
    '**Results:**', results_text, CASE WHEN insights <> '' THEN '**Key Insights:**' || chr(10) || insights END,
    CASE WHEN month LIKE '%-01' THEN '**Figure File:** plot_' || month || '.html' END, chr(10) || '---') AS block
  FROM fields)"""

MARKDOWN_SQL = f"""
WITH {RESULTS_SQL}, fields AS (SELECT project, seq, month, {RESULT_FIELDS_SQL} FROM results), {BLOCK_SQL}
SELECT project, 0::BIGINT AS part,
       '## Analysis Results Summary' || chr(10) || chr(10)
       || string_agg(block, chr(10) || chr(10) ORDER BY seq) AS markdown
FROM blocks GROUP BY project
UNION ALL SELECT 'X', 0, 'No analysis results available.'"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents.results_markdown(numbered_results(spark, sf_dir))
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("project")).distinct()
    wanted = projects.unionByName(spark.createDataFrame([("X",)], "project string"))
    return documents.with_empty_projects(parts, wanted, "markdown", documents.NO_RESULTS)


@query("results_markdown", MARKDOWN_SQL)
def results_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir)


@query(
    "task_digest",
    f"""
WITH {RESULTS_SQL}, fields AS (SELECT project, seq, {RESULT_FIELDS_SQL} FROM results)
SELECT project, 0::BIGINT AS part, 'Summary of Previous Tasks:' || chr(10) || string_agg(
       '- Task ' || seq || ': ' || left(coalesce(task, 'N/A'), 60) || '...', chr(10) ORDER BY seq) AS digest
FROM fields GROUP BY project
UNION ALL SELECT 'X', 0, 'No previous analysis tasks completed in this session.'""",
)
def task_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents.task_digest(numbered_results(spark, sf_dir), "project", "seq", "task")
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("project")).distinct()
    wanted = projects.unionByName(spark.createDataFrame([("X",)], "project string"))
    return documents.with_empty_projects(parts, wanted, "digest", documents.NO_PREVIOUS_TASKS)


@query(
    "results_ledger",
    f"WITH {RESULTS_SQL} SELECT project, seq, {RESULT_FIELDS_SQL} FROM results",
)
def results_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two goes, exported as JSON and read back."""
    ledger, copy = scratch_path(spark, "ledger"), scratch_path(spark, "ledger_json")
    results = monthly_results(spark, sf_dir).drop("plot_file")
    exports.append_results(results.where("month < '1998'"), ledger, ["month"])
    exports.append_results(results.where("month >= '1998'"), ledger, ["month"])
    exports.export_ledger_json(exports.read_ledger(spark, ledger), copy)
    back = sources.read_json(spark, copy, exports.read_ledger(spark, ledger).schema)
    return back.withColumn("files", F.array_join("files", ", "))


@query(
    "report_sink",
    f"""
WITH m AS (SELECT project, markdown FROM ({MARKDOWN_SQL}))
SELECT project, unnest(string_split(markdown, chr(10))) AS value FROM m""",
)
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the reports, each written under its project's name."""
    path = scratch_path(spark, "report")
    exports.report_sink(_markdown(spark, sf_dir), "markdown", path, ["project", "part"], name="project")
    return exports.read_reports(spark, path, "project")


TASK_TEMPLATE = (
    "Project {project}: {problem_statement}\n{previous_results_summary}\nTask: {task_to_execute}\n"
    "Files: {file_names}\nColumns: {available_columns}\nSample: {data_sample}"
)


@query(
    "task_prompts",
    f"""
WITH {RESULTS_SQL}, fields AS (SELECT project, seq, {RESULT_FIELDS_SQL} FROM results),
d AS (SELECT project, 'Summary of Previous Tasks:' || chr(10) || string_agg(
        '- Task ' || seq || ': ' || left(coalesce(task, 'N/A'), 60) || '...', chr(10) ORDER BY seq) AS digest
      FROM fields WHERE project <> 'P' GROUP BY project),
s AS (SELECT to_json(list({{'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}} ORDER BY n_nationkey))::VARCHAR
        AS sample FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5))
SELECT project, seq, 'Project ' || project || ': why {{orders}} of ' || project || ' rise' || chr(10)
       || coalesce(digest, 'No previous analysis tasks completed in this session.') || chr(10) || 'Task: ' || coalesce(task, 'None')
       || chr(10) || 'Files: nation, orders' || chr(10) || 'Columns: n_nationkey, n_name, n_regionkey' || chr(10)
       || 'Sample: ' || sample AS prompt
FROM fields LEFT JOIN d USING (project), s""",
)
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every task, with a sample of the data and the digest of the project's results; project P has none yet."""
    results = numbered_results(spark, sf_dir)
    digests = documents.task_digest(results.where("project <> 'P'"), "project", "seq", "task", span=None)
    problem = F.concat(F.lit("why {orders} of "), "project", F.lit(" rise")).alias("problem_statement")
    tasks = results.select("project", "seq", F.col("task").alias("task_to_execute"), problem)
    datasets = {t: table(spark, sf_dir, t) for t in ("nation", "orders")}
    return overview.task_prompts(tasks, TASK_TEMPLATE, datasets, ["n_nationkey"], digests, documents.NO_PREVIOUS_TASKS)


@query(
    "joined_names",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, (SELECT string_agg(column_name, ', ') FROM (DESCRIBE {t})) AS columns, count(*) AS n_rows FROM {t}"
        for t in TABLES
    ),
)
def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = {t: table(spark, sf_dir, t) for t in TABLES}
    return profile_names(datasets).join(dataset_shape(datasets).select("dataset", "n_rows"), "dataset")


def _context_sql() -> str:
    tables = []
    for i, name in enumerate(TABLES):
        tables.append(
            f"SELECT 0 AS kind, {i} AS position, chr(10) || 'File: {name}' || chr(10) || '- Columns: [' || "
            f"(SELECT string_agg('''' || column_name || '''', ', ') FROM (DESCRIBE {name})) || ']' || chr(10) || "
            f"'- Shape: (' || count(*) || ', ' || (SELECT count(*) FROM (DESCRIBE {name})) || ')' || chr(10) AS block "
            f"FROM {name}"
        )
    texts = (
        "SELECT 1, doc_id, chr(10) || 'File: doc_' || doc_id || chr(10) || '- Type: Text Document' || chr(10) || "
        "'- Snippet: ' || CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END || chr(10) "
        "FROM documents"
    )
    return (
        f"WITH b AS ({' UNION ALL '.join(tables)} UNION ALL {texts}) "
        "SELECT kind, (position // 1000)::BIGINT AS part, string_agg(block, '' ORDER BY position) AS context "
        "FROM b GROUP BY kind, part"
    )


@query("context_render", _context_sql())
def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = {t: table(spark, sf_dir, t) for t in TABLES}
    texts = table(spark, sf_dir, "documents")
    named = documents.text_blocks(texts, F.concat(F.lit("doc_"), "doc_id"), "text", F.col("doc_id"))
    return documents.context_render(datasets, dataset_shape(datasets), named)


@query(
    "context_whole",
    f"SELECT 0 AS kind, 0::BIGINT AS part, string_agg(context, '' ORDER BY kind) AS context FROM ({_context_sql()}) WHERE kind = 0",
)
def context_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables in one context."""
    datasets = {t: table(spark, sf_dir, t) for t in TABLES}
    return documents.context_render(datasets, dataset_shape(datasets), span=None)


@query(
    "fragment_concat_sparse",
    """
WITH f AS (SELECT conv_id, turn * 5000 + conv_id % 3 AS place, text FROM conversations)
SELECT conv_id AS doc, 0::BIGINT AS part, string_agg(text, chr(10) ORDER BY place) AS text FROM f GROUP BY conv_id""",
)
def fragment_concat_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions far apart make no parts."""
    talk = table(spark, sf_dir, "conversations").withColumn("place", F.col("turn") * 5000 + F.col("conv_id") % 3)
    return documents.fragment_concat(talk, "conv_id", "place", "text")


@query(
    "fragment_concat_corpus",
    """
WITH f AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS spot FROM documents)
SELECT lang AS doc, (spot // 100)::BIGINT AS part, string_agg(text, chr(10) ORDER BY spot) AS text FROM f GROUP BY lang, part""",
)
def fragment_concat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a language as the parts of one text, a hundred to a part."""
    docs = number_within(table(spark, sf_dir, "documents"), ["lang"], [F.col("doc_id")], "at")
    placed = docs.withColumn("at", F.col("at") - 1)
    return documents.fragment_concat(placed, "lang", "at", "text", span=100)
