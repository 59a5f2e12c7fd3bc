"""Guidance and reply texts cut into tasks and sections, row by row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.text import SPACE, is_filled, strip

# Marker lines, sentinels and messages.
STOP_LINE = "5. Develop Narrative:"
MANUAL_TASK = "Manually define task below"
MANUAL_GUIDANCE = "Manually define task based on guidance above."
NO_RESPONSE = "Error: No response from Analyst."
SECTIONS = ["approach", "code", "results_text", "insights"]

# Line ends and in-line blanks as Python sees them (str.splitlines and \s), and the
# forms of task and section headers.
_BREAKS = r"\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029"
_BLANK = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_TASK_HEADER = rf"{_BLANK}*\**{_BLANK}*Task{_BLANK}*\p{{Nd}}+\.?{_BLANK}*\**:"

# The optional sign after "python" and "key" covers their last letter only.
_SECTION_HEADER = (
    rf"(?imdU)^{SPACE}*\d*\.?{SPACE}*\**(approach|python?{SPACE}*code|results|key?{SPACE}*insights)\**:"
)


def task_blocks(df: DataFrame, key: str, guidance: str) -> DataFrame:
    """key, pos, task; positions start at 1 and the manual-entry sentinel comes last.

    Null or empty guidance gives no row, blank guidance a fixed sentence, and guidance without any
    task header is one block.
    """
    # One projection per step: an expression used twice in one projection would run twice.
    text = df.select(F.col(key).alias("key"), F.col(guidance).alias("_text")).where(is_filled(F.col("_text")))
    stop = F.instr("_text", STOP_LINE)
    upto = F.when(stop > 0, F.substring(F.col("_text"), F.lit(1), stop - 1)).otherwise(F.col("_text"))
    found = text.select("key", "_text", (stop > 0).alias("_stops"), upto.alias("_upto"))
    # The whole line with the stop words goes. Its start is searched in the last stretch only.
    line = F.element_at(F.split(F.substring_index("_upto", "\n", -1), f"[{_BREAKS}]"), -1)
    kept = F.when(F.col("_stops"), F.substring(F.col("_upto"), F.lit(1), F.length("_upto") - F.length(line)))
    pieces = F.split(kept.otherwise(F.col("_upto")), rf"(?iu)(?<=[{_BREAKS}])(?={_TASK_HEADER})")
    # Only the first piece can lack a header: it is what comes before the first task.
    cut = found.select("key", strip(F.col("_text")).alias("_text"), pieces.alias("_pieces"))
    headed = F.rlike(F.col("_pieces")[0], F.lit(rf"(?iu)^{_TASK_HEADER}"))
    first = F.when(headed, F.col("_pieces")).otherwise(F.slice("_pieces", 2, F.size("_pieces")))
    blocks = cut.select("key", "_text", F.transform(first, strip).alias("_blocks"))
    whole = F.when(F.size("_blocks") > 0, F.col("_blocks")).otherwise(F.array("_text"))
    kept = F.array_distinct(F.array_remove(whole, MANUAL_TASK))
    tasks = F.when(F.col("_text") == "", F.array(F.lit(MANUAL_GUIDANCE))).otherwise(
        F.concat(kept, F.array(F.lit(MANUAL_TASK)))
    )
    rows = blocks.select("key", F.posexplode(tasks).alias("p", "task"))
    return rows.select("key", (F.col("p") + 1).cast("long").alias("pos"), "task")


def _section_of(header: Column) -> Column:
    first = F.lower(F.substring(header, 1, 1))
    return (
        F.when(first == "a", F.lit("approach"))
        .when(first == "p", F.lit("code"))
        .when(first == "r", F.lit("results_text"))
        .otherwise(F.lit("insights"))
    )


def _clean(name: str, body: Column) -> Column:
    body = strip(F.regexp_replace(strip(body), rf"(?U)^{SPACE}*\*\*", ""))
    body = strip(F.regexp_replace(body, rf"(?U)\*\*{SPACE}*$", ""))
    if name == "code":
        body = strip(F.regexp_replace(body, r"(?i)```python\n?|```", ""))
    return body


def response_sections(df: DataFrame, key: str, reply: str) -> DataFrame:
    """key, approach, code, results_text, insights. A repeated header: its last body wins."""
    text = df.select(F.col(key).alias("key"), F.col(reply).alias("_text"))
    cut = text.select(
        "key",
        "_text",
        F.regexp_extract_all("_text", F.lit(_SECTION_HEADER), 1).alias("_headers"),
        F.split("_text", _SECTION_HEADER).alias("_bodies"),
    )
    found = cut.select(
        "key",
        "_text",
        F.zip_with(
            "_headers",
            F.slice("_bodies", 2, F.size("_headers")),
            lambda h, b: F.struct(_section_of(h).alias("name"), b.alias("body")),
        ).alias("_found"),
    )

    def last_body(name: str) -> Column:
        return F.get(F.filter(F.reverse("_found"), lambda s: s["name"] == name), F.lit(0))["body"]

    out = []
    for name in SECTIONS:
        body = last_body(name)
        parsed = F.coalesce(_clean(name, body), F.lit(f"Could not parse '{name}' section."))
        missing = F.lit(NO_RESPONSE if name == "approach" else "")
        out.append(F.when(is_filled(F.col("_text")), parsed).otherwise(missing).alias(name))
    return found.select("key", *out)


def distinct_in_order(values: Column, last: str | None = None) -> Column:
    """Array without repeats, first occurrence kept; ``last`` moves to the end."""
    unique = F.array_distinct(values)
    if last is None:
        return unique
    ending = F.when(F.array_contains(unique, last), F.array(F.lit(last)))
    return F.concat(F.array_remove(unique, last), F.coalesce(ending, F.array().cast("array<string>")))


LAST_POSITION = 9223372036854775807


def ordered_dedup(df: DataFrame, key: str, pos: str, value: str, last: str | None = None) -> DataFrame:
    """key, pos, value of each value's first row; ``last`` gets the greatest position there is.

    A minimum per value needs no group in one place, so any number of repeats is fine.
    """
    first = df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(
        F.min(F.col(pos).cast("long")).alias("pos")
    )
    if last is not None:
        moved = F.when(F.col("value") == last, F.lit(LAST_POSITION)).otherwise(F.col("pos"))
        first = first.withColumn("pos", moved)
    return first.select("key", "pos", "value")
