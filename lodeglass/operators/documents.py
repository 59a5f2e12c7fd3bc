"""Ordered text assembly: documents from fragments, context, digests and Markdown reports.

A group's pieces are gathered in parts of fewer than ``2 * span`` pieces, so no task ever holds an
unbounded group. A group of ordinary size is a single part 0; a larger one is the concatenation of
its parts 0, 1, … in order, whatever its positions are and however far apart. ``span=None`` asks for one text per group, which then has to fit
into a task. Positions are integers; a null position, or one that occurs twice in its group, is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeglass.functions.text import is_filled, snippet, strip
from lodeglass.operators.joins import join_on
from lodeglass.operators.profile import union_all
from lodeglass.session import materialise

SPAN = 1000

# Sentences, headings, labels and line formats of the rendered texts.
NO_RESULTS = "No analysis results available."
RESULTS_HEADING = "## Analysis Results Summary"
NO_PREVIOUS_TASKS = "No previous analysis tasks completed in this session."
DIGEST_HEADING = "Summary of Previous Tasks:"
NO_FILES = "No data files loaded."
FILES_LABEL = "**Files Used:** "
APPROACH_LABEL = "**Approach:**"
CODE_LABEL = "**Python Code:**"
RESULTS_LABEL = "**Results:**"
INSIGHTS_LABEL = "**Key Insights:**"
FIGURE_LABEL = "**Figure File:** "
DIGEST_LINE = "- Task %d: %s..."
TABLE_BLOCK = "\nFile: %s\n- Columns: %s\n- Shape: (%d, %d)\n"
TEXT_BLOCK = "\nFile: %s\n- Type: Text Document\n- Snippet: %s\n"


def assemble(
    df: DataFrame, group: list[str], position: str, text: str, separator: str, out: str, span: int | None = SPAN
) -> DataFrame:
    """group columns, part, ``out``: the texts of each part joined in position order."""
    known = F.when(F.col(position).isNull(), F.raise_error(F.lit("a position is null"))).otherwise(F.col(position))
    if span is None:
        parted = df.withColumn("part", F.lit(0).cast("long"))
    else:
        block = F.floor(known / span).cast("long")
        moved = _moved_blocks(df, group, block, span)
        blocked = df.withColumn("_block", block)
        parted = join_on(blocked, moved, [*group, "_block"], "left").withColumn("part", F.coalesce("part", "_block"))
    gathered = parted.groupBy(*group, "part").agg(
        F.collect_list(F.struct(known.alias("p"), F.col(text).alias("t"))).alias("_pieces")
    )
    pieces = F.array_sort("_pieces")
    again = F.size(F.array_distinct(F.transform("_pieces", lambda piece: piece["p"]))) < F.size("_pieces")
    checked = F.when(again, F.raise_error(F.lit("a position occurs twice"))).otherwise(pieces)
    texts = F.transform(checked, lambda piece: piece["t"])
    return gathered.select(*group, "part", F.array_join(texts, separator).alias(out))


def _moved_blocks(df: DataFrame, group: list[str], block: Column, span: int) -> DataFrame:
    """group columns, _block, part of the blocks of ``span`` positions whose part is not their own number.

    Blocks are taken together in order until ``span`` pieces have gone before. Groups with positions 0, 1, 2, … have none, so this
    table is small, and written so that the planner knows it.
    """
    keys = group or ["_all"]
    rows = df if group else df.withColumn("_all", F.lit(0))
    sizes = rows.groupBy(*keys, block.alias("_block")).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("_size").over(before), F.lit(0))
    placed = sizes.select(*group, "_block", F.floor(gone / span).alias("_after"))
    ranked = placed.withColumn(
        "part", (F.dense_rank().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_after")) - 1).cast("long")
    )
    return materialise(ranked.where(F.col("part") != F.col("_block")).select(*group, "_block", "part"), "moved")


def _headed(parts: DataFrame, out: str, heading: str) -> DataFrame:
    """``parts`` with the heading on the first."""
    return parts.withColumn(out, F.when(F.col("part") == 0, F.concat(F.lit(heading), F.col(out))).otherwise(F.col(out)))


def fragment_concat(
    df: DataFrame, doc: str, seq: str, text: str, mode: str = "paragraphs", span: int | None = SPAN
) -> DataFrame:
    """doc, part, text.

    ``paragraphs``: pieces joined by a line end, empty ones kept; parts join by a line end too.
    ``pages``: empty pages dropped, each kept page ends with a line end; parts join directly.
    """
    pieces = df.select(F.col(doc).alias("doc"), F.col(seq).alias("seq"), F.col(text).alias("text"))
    if mode == "pages":
        pages = pieces.where(is_filled(F.col("text"))).withColumn("text", F.concat("text", F.lit("\n")))
        return assemble(pages, ["doc"], "seq", "text", "", "text", span)
    filled = pieces.withColumn("text", F.coalesce("text", F.lit("")))
    return assemble(filled, ["doc"], "seq", "text", "\n", "text", span)


def task_digest(results: DataFrame, project: str, seq: str, task: str, span: int | None = SPAN) -> DataFrame:
    """project, part, digest: one dotted line per task, numbered by ``seq`` (1, 2, …).

    The first part carries the heading. Parts join by a line end. See ``with_empty_projects``.
    """
    title = F.substring(F.coalesce(F.col(task), F.lit("N/A")), 1, 60)
    line = F.format_string(DIGEST_LINE, F.col(seq), title)
    lines = results.select(F.col(project).alias("project"), (F.col(seq) - 1).alias("_at"), line.alias("line"))
    parts = assemble(lines, ["project"], "_at", "line", "\n", "digest", span)
    return _headed(parts, "digest", DIGEST_HEADING + "\n")


def with_empty_projects(parts: DataFrame, projects: DataFrame, column: str, sentence: str) -> DataFrame:
    """Add projects that have no result, with the fixed sentence as their only part."""
    listed = projects.select("project").distinct()
    return listed.join(parts, "project", "full").select(
        "project",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce(column, F.lit(sentence)).alias(column),
    )


def _section(label: str, body: Column) -> Column:
    """Label and stripped body on two lines; null, hence skipped, when there is no body."""
    return F.when(is_filled(body), F.concat(F.lit(label + "\n"), strip(body)))


def _figure_lines(results: DataFrame) -> Column:
    """The first filled figure- or plot-named column, one line per reference."""
    found: list[Column] = []
    for field in results.schema.fields:
        if "figure" not in field.name.lower() and "plot" not in field.name.lower():
            continue
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            lines = F.transform(c, lambda f: F.concat(F.lit(FIGURE_LABEL), f.cast("string")))
            found.append(F.when(F.size(c) > 0, F.array_join(lines, "\n")))
        else:
            found.append(F.when(is_filled(c.cast("string")), F.concat(F.lit(FIGURE_LABEL), c.cast("string"))))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def results_blocks(results: DataFrame, project: str = "project", seq: str = "seq") -> DataFrame:
    """project, seq, block: the Markdown of every result as its own row.

    Expects the ledger columns task, files, approach, code, results_text, insights; the last five
    may be absent. ``seq`` numbers a project's results 1, 2, ….
    """
    have = set(results.columns)

    def text(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    body = F.when(is_filled(text("results_text")), text("results_text")).otherwise(text("results"))
    number = F.col(seq).cast("string")
    title = F.coalesce(text("task"), F.concat(F.lit("Task "), number))
    files = F.lit(None).cast("string")
    if "files" in have:
        files = F.when(F.size("files") > 0, F.concat(F.lit(FILES_LABEL), F.array_join("files", ", ")))
    code = F.when(
        is_filled(text("code")),
        F.concat(F.lit(CODE_LABEL + "\n```python\n"), strip(text("code")), F.lit("\n```")),
    )
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### Task "), number, F.lit(": "), title),
        files,
        _section(APPROACH_LABEL, text("approach")),
        code,
        _section(RESULTS_LABEL, body),
        _section(INSIGHTS_LABEL, text("insights")),
        _figure_lines(results),
        F.lit("\n---"),
    )
    return results.select(F.col(project).alias("project"), F.col(seq).alias("seq"), block.alias("block"))


def results_markdown(
    results: DataFrame, project: str = "project", seq: str = "seq", span: int | None = SPAN
) -> DataFrame:
    """project, part, markdown. The first part carries the heading; parts join by an empty line."""
    blocks = results_blocks(results, project, seq).withColumn("_at", F.col("seq") - 1)
    parts = assemble(blocks, ["project"], "_at", "block", "\n\n", "markdown", span)
    return _headed(parts, "markdown", RESULTS_HEADING + "\n\n")


def table_blocks(datasets: dict[str, DataFrame], shapes: DataFrame) -> DataFrame:
    """position, block: one block per dataset from its schema and shape."""
    spark = shapes.sparkSession
    rows = [(i, name, str(df.columns)) for i, (name, df) in enumerate(datasets.items())]
    listing = spark.createDataFrame(rows, "position long, dataset string, columns string")
    block = F.format_string(TABLE_BLOCK, "dataset", "columns", "n_rows", "n_cols")
    return listing.join(shapes, "dataset").select("position", block.alias("block"))


def text_blocks(texts: DataFrame, name: Column, text: str, position: Column) -> DataFrame:
    """position, block: one block per document with a 100-character snippet."""
    block = F.format_string(TEXT_BLOCK, name, snippet(F.col(text), 100))
    return texts.select(position.alias("position"), block.alias("block"))


def context_render(
    datasets: dict[str, DataFrame], shapes: DataFrame | None, texts: DataFrame | None = None, span: int | None = SPAN
) -> DataFrame:
    """kind, part, context: table blocks (kind 0) before text blocks (kind 1); parts join directly.

    ``shapes`` is the result of ``dataset_shape`` and ``texts`` that of ``text_blocks``. Without any
    block the context is one fixed sentence. With ``span=None`` all is one context, of kind 0 and part 0.
    """
    blocks = []
    if datasets:
        blocks.append(table_blocks(datasets, shapes))
    if texts is not None:
        blocks.append(texts)
    if not datasets and (texts is None or texts.isEmpty()):
        return SparkSession.active().createDataFrame([(0, 0, NO_FILES)], "kind int, part long, context string")
    return one_after_another(blocks, "context", span, first=0 if datasets else 1)


def one_after_another(
    kinds: list[DataFrame], out: str, span: int | None, first: int = 0
) -> DataFrame:
    """kind, part, ``out``: (position, block) rows of several kinds, assembled kind by kind, or as one text with ``span=None``."""
    blocks = union_all([b.select(F.lit(i).alias("kind"), "position", "block") for i, b in enumerate(kinds, first)])
    if span is not None:
        return assemble(blocks, ["kind"], "position", "block", "", out, span)
    pieces = F.array_sort(F.collect_list(F.struct("kind", "position", "block")))
    whole = blocks.agg(F.array_join(F.transform(pieces, lambda p: p["block"]), "").alias(out))
    return whole.select(F.lit(first).alias("kind"), F.lit(0).cast("long").alias("part"), out)


def conversation_log(df: DataFrame, conversation: str, seq: str, role: str, content: str) -> DataFrame:
    """conv_id, seq, role, content: content forced to text, order kept as a column."""
    return df.select(
        F.col(conversation).alias("conv_id"),
        F.col(seq).cast("long").alias("seq"),
        F.col(role).alias("role"),
        F.col(content).cast("string").alias("content"),
    )


def conversation_rollup(log: DataFrame) -> DataFrame:
    """conv_id, role, n, chars."""
    return log.groupBy("conv_id", "role").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars")
    )
